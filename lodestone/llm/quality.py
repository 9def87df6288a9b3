"""Quality rules with risk-controlled thresholds.

Every text gets signals of its words, symbols, repeated lines and repeated passages. Fixed base rules
reject at once. On top of them, one cutoff for each signal and stratum (language) is chosen from labelled
holdouts: going from the mildest to the strictest candidate of a fixed grid, a cutoff is certified if the
exact (Clopper-Pearson) upper bound of the share of good documents that it rejects is at most
RISK / number of signals, and the first that isn't ends the sequence. Such a fixed sequence needs no correction
for its candidates, so DELTA is shared among strata and signals only (weighted Bonferroni, see levels()). Of the certified cutoffs the
mildest is used for which the share of bad documents that it rejects, less WEIGHT times that of the good, is greatest.
The cutoffs together so reject at most RISK of those good documents of a stratum that pass the base rules, with probability 1 - DELTA; what the
base rules reject comes on top of it.

Strata with fewer than MIN_GOOD good labelled documents, or with so few that not even a cutoff without errors
could be certified (see levels()), share one pooled stratum, so there are at most (labelled rows / MIN_GOOD) + 1 of
them. A pool that is itself too small has no cutoffs and takes no share of DELTA. Without labels, only the base rules hold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Texts, doc_texts, materialise, maybe_broadcast, mix64, trimmed

RISK, DELTA, MIN_GOOD, WEIGHT = 0.02, 0.05, 1000, 10
WINDOW = 8
#: Signal: (expression of a bin that grows with badness, number of bins).
SIGNALS = {
    "symbols": ("least(400, floor(100 * n_symbols / n_words))", 401),
    "repeats": ("least(100, floor(100 * n_repeat_words / n_words))", 101),
    "lines": ("least(100, floor(100 * n_dup_lines / n_words))", 101),
    "long_words": ("least(200, floor(10 * word_chars / n_words))", 201),
    "short_words": ("200 - least(200, floor(10 * word_chars / n_words))", 201),
}
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: The fixed rules.
BASE = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _sums(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])


def _counts(texts: Texts) -> list[np.ndarray]:
    n, data = texts.n, texts.data
    first, end, doc = texts.words()
    n_words = np.bincount(doc, minlength=n)
    points = _sums((data & 0xC0) != 0x80)
    word_chars = np.zeros(n, np.int64)
    np.add.at(word_chars, doc, points[end] - points[first])
    n_symbols = np.diff(_sums(_SYMBOL[data])[texts.starts])

    breaks = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([texts.starts[:-1], breaks + 1]))
    stop = np.sort(np.concatenate([texts.starts[1:], breaks]))
    words_before = np.searchsorted(first, begin), np.searchsorted(first, stop)
    full = words_before[1] > words_before[0]
    begin, stop = begin[full], stop[full]
    line_doc = np.searchsorted(texts.starts, begin, side="right") - 1
    lines = texts.word_hashes(begin, stop) if len(begin) else np.zeros(0, np.uint64)
    n_dup_lines = np.bincount(line_doc, minlength=n) - np.bincount(line_doc[_firsts(lines, line_doc)[0]], minlength=n)

    n_repeat = np.zeros(n, np.int64)
    at = len(first) - WINDOW + 1
    if at > 0:
        h, s = texts.word_hashes(first, end), np.zeros(at, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(WINDOW):
                s = mix64(s ^ h[k : k + at])
        whole = np.flatnonzero(doc[:at] == doc[WINDOW - 1 :])
        new, group = _firsts(s[whole], doc[whole])
        often = whole[np.bincount(group, minlength=len(new))[group] > 1]
        cover = np.zeros(len(first) + 1, np.int64)
        np.add.at(cover, often, 1)
        np.add.at(cover, often + WINDOW, -1)
        n_repeat = np.bincount(doc[np.cumsum(cover)[:-1] > 0], minlength=n)
    return [n_words, word_chars, n_symbols, n_dup_lines, n_repeat]


def _firsts(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One index for each distinct (doc, h), and for each row the number of its group."""
    order = np.lexsort((h, doc))
    if not len(order):
        return order, order
    new = np.ones(len(order), dtype=bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return order[new], group


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, texts in doc_texts(batch.column(1)):
            counts = [pa.array(x.astype(np.int64)) for x in _counts(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), *counts], ["doc", *COUNTS])


def measure(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(doc, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words); doc is a struct of docs' columns."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(trimmed(_measure), _measured(rows)).withColumn("base_failed", F.expr(BASE))


def _measured(rows: DataFrame) -> StructType:
    return StructType([rows.schema["doc"], *(StructField(c, LongType()) for c in COUNTS)])


def upper_bound(errors: int, n: int, delta: float) -> float:
    """The exact upper confidence bound of a binomial rate: the p at which errors or fewer of n have probability delta."""
    if errors >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) for k in range(errors + 1)]
    low, high = errors / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        terms = [c + k * math.log(p) + (n - k) * math.log1p(-p) if p < 1 else -math.inf for k, c in enumerate(logs)]
        top = max(terms)
        if top + math.log(sum(math.exp(t - top) for t in terms)) > math.log(delta):
            low = p
        else:
            high = p
    return high


def levels(good: dict[str, int], risk: float = RISK, delta: float = DELTA) -> dict[str, float]:
    """Of good labels by stratum, the share of delta for each signal of the strata that can be certified, the largest first.

    Each gets what a cutoff without errors needs at its size, and an equal part of what is left. Only the sizes count.
    """
    share, needs, used = delta / len(SIGNALS), {}, 0.0
    for s in sorted(good, key=lambda s: (-good[s], s)):
        need = (1 - risk / len(SIGNALS)) ** good[s]
        if used + need > share:
            break
        needs[s], used = need, used + need
    return {s: need + (share - used) / len(needs) for s, need in needs.items()}


def own_strata(good: dict[str, int], risk: float = RISK, delta: float = DELTA, min_good: int = MIN_GOOD) -> list[str]:
    """Of good labels by stratum, the strata that aren't pooled: as many of the largest as can all be certified."""
    names = sorted((s for s in good if s and good[s] >= min_good), key=lambda s: (-good[s], s))
    for k in range(len(names), 0, -1):
        own = {s: good[s] for s in names[:k]}
        if own.keys() <= levels(own | {"": sum(good.values()) - sum(own.values())}, risk, delta).keys():
            return names[:k]
    return []


def choose_cutoffs(good: dict, bad: dict, risk: float = RISK, delta: float = DELTA) -> dict[tuple[str, str], int]:
    """(stratum, signal): the least bin that is rejected. good, bad: (stratum, signal) -> counts by bin."""
    level = levels({s: int(sum(x)) for (s, _), x in good.items()}, risk, delta)
    chosen = {}
    for key, counts in good.items():
        n, rejected, n_bad, rejected_bad, best = int(sum(counts)), 0, int(sum(bad[key])), 0, 0.0
        for b in range(len(counts) - 1, 0, -1):
            rejected += int(counts[b])
            rejected_bad += int(bad[key][b])
            if key[0] not in level or rejected > risk / len(SIGNALS) * n or upper_bound(rejected, n, level[key[0]]) > risk / len(SIGNALS):
                break
            worth = rejected_bad / max(1, n_bad) - WEIGHT * rejected / n
            if worth > best:  # of equally good ones the mildest stays
                best, chosen[key] = worth, b
    return chosen


def fit(measured: DataFrame, labels: DataFrame, *, risk: float = RISK, delta: float = DELTA, min_good: int = MIN_GOOD) -> DataFrame:
    """(stratum, cut_<signal>...) for every stratum of its own and for the pooled one ''; a null cutoff rejects nothing.

    measured: (doc_id, stratum, counts, base_failed); labels: (doc_id, quality 0/1, nulls ignored; of several labels the best counts).
    """
    spark = measured.sparkSession
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = measured.where("NOT base_failed AND n_words > 0").join(marks, "doc_id")
    sizes = known.where("quality = 1").groupBy("stratum").count()
    # what has a name and under min_good is pooled in any case, so at most labelled rows / min_good + 1 rows come to the driver
    sizes = sizes.groupBy(F.when(F.col("count") >= min_good, F.col("stratum")).otherwise("").alias("stratum")).agg(F.sum("count").alias("n"))
    own = own_strata({r.stratum: r.n for r in sizes.collect()}, risk, delta, min_good)
    stratum = F.when(F.col("stratum").isin(own), F.col("stratum")).otherwise("") if own else F.lit("")
    bins = known.select(stratum.alias("stratum"), "quality", F.expr("stack(%d, %s) AS (signal, bin)" % (len(SIGNALS), ", ".join(f"'{k}', cast({e} AS int)" for k, (e, _) in SIGNALS.items()))))
    keys = [(s, k) for s in [*own, ""] for k in SIGNALS]
    hist = {q: {(s, k): np.zeros(SIGNALS[k][1], np.int64) for s, k in keys} for q in (0, 1)}
    for r in bins.groupBy("stratum", "quality", "signal", "bin").count().collect():  # at most strata x 2 x 1005 rows
        hist[int(r.quality > 0)][(r.stratum, r.signal)][max(0, r.bin)] += r["count"]
    cut = choose_cutoffs(hist[1], hist[0], risk, delta)
    rows = [(s, *[cut.get((s, k)) for k in SIGNALS]) for s in [*own, ""]]
    return spark.createDataFrame(rows, "stratum string, " + ", ".join(f"cut_{k} int" for k in SIGNALS))


def decide(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """measured (with stratum) and kept."""
    pool = cutoffs.where("stratum = ''").first()
    own = cutoffs.where("stratum != ''").withColumn("own", F.lit(True))
    # strata of their own: at most labelled rows / min_good, and the size is checked
    out = measured.join(maybe_broadcast(own), "stratum", "left")
    fails = [F.coalesce(F.expr(f"{e} >= if(own, cut_{k}, {'NULL' if pool[f'cut_{k}'] is None else pool[f'cut_{k}']})"), F.lit(False)) for k, (e, _) in SIGNALS.items()]
    verdict = F.col("base_failed")
    for x in fails:
        verdict = verdict | x
    return out.select(*measured.columns, (~verdict).alias("kept"))


def quality_verdicts(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", risk: float = RISK) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Words are runs without ASCII white space. Null and empty texts have no words and fail the base rules.
    A null stratum counts as the pooled one. Repeated rows each get a row; an empty table gives none, and
    other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), F.col(text_col).alias("text"))
    return decide(*_fitted(rows, labels, risk)).select("doc_id", *COUNTS, "base_failed", "kept")


def _fitted(rows: DataFrame, labels: DataFrame, risk: float) -> tuple[DataFrame, DataFrame]:
    measured = measure_slim(rows)
    measured = materialise(measured, "quality")
    return measured, fit(measured, labels, risk=risk)


def measure_slim(rows: DataFrame) -> DataFrame:
    """measure() of (doc_id, stratum, text) without the text in its result."""
    slim = rows.select(F.struct("doc_id", "stratum").alias("doc"), "text")
    return slim.mapInArrow(trimmed(_measure), _measured(slim)).select("doc.*", *COUNTS, F.expr(BASE).alias("base_failed"))


def keep_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", risk: float = RISK) -> DataFrame:
    """The rows of docs that pass. Texts are measured once: the rows are written with their counts, from which the cutoffs are fitted and applied."""
    measured = materialise(measure(docs, text_col=text_col), "quality-rows")
    slim = measured.select(F.col(f"doc.`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"doc.`{stratum_col}`").cast("string"), F.lit("")).alias("stratum"), *COUNTS, "base_failed")
    cutoffs = fit(slim, labels, risk=risk)
    measured = measured.withColumn("stratum", F.coalesce(F.col(f"doc.`{stratum_col}`").cast("string"), F.lit("")))
    return decide(measured, cutoffs).where("kept").select("doc.*")
