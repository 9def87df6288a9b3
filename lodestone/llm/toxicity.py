"""Toxicity scores by weak supervision: voters, a generative label model, and a linear classifier.

1. Two bounded samples, by hashes of ids over all rows, are turned into features by the executors: at most SAMPLE labelled documents of
   each label, and at most UNLABELLED documents without regard to labels. The bounds are parameters; texts don't come to the driver.
2. Voters are mined from one half of the labelled documents, with labels as a development set: a lexicon voter for each whole word and for
   each word beginning of 4 to 6 bytes that comes in toxic texts far more often than in others, and pattern voters (shouting,
   exclamation, masked words). A voter that fires votes "toxic"; one that doesn't abstains in the direction of "not toxic".
3. Label model: the votes on the unlabelled documents are generated from a hidden class. EM estimates the class's share, each
   class's firing rates, which are the voters' accuracies and coverages, and their covariance within the classes, which holds the voters'
   correlations (beginnings of the same word vote together): a voter's log-odds are divided by the sum of its
   correlations, so voters that agree within the classes count as one. The votes on the other half of the labelled documents are a prior
   of the rates, which tells the classes apart and holds them; a document's own label has no part in its posterior.
4. A logistic regression on hashed words, word beginnings and patterns is trained on the posterior labels of both samples
   and scores every whole text. It is one vector of DIM floats, so scoring is one scan without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, doc_texts, materialise, mix64, sorted_sets, trimmed

SAMPLE, UNLABELLED, DIM, LENGTHS, VOTERS, LEAST_RATE, CORRELATED, Z = 4000, 16_000, 1 << 18, (4, 5, 6), 256, 1e-3, 0.5, 8.0
PATTERNS = 3
_BANG = np.zeros(256, dtype=np.int64)
_BANG[ord("!")] = 1
_STAR = np.zeros(256, dtype=np.int64)
_STAR[[ord(c) for c in "*#@$"]] = 1
_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1
# bytes that are part of a word once a text is cut at white space: letters, digits and all beyond ASCII
_WORDY = np.zeros(256, dtype=bool)
_WORDY[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct feature hashes of each text (whole words and their beginnings), their texts, and PATTERNS flags of each text."""
    low = texts.lowered()
    clean = Texts(np.where(_WORDY[low.data], low.data, 32).astype(np.uint8), low.starts)
    first, end, doc = clean.words()
    with np.errstate(over="ignore"):
        parts, docs = [clean.word_hashes(first, end)], [doc]
        for k in LENGTHS:
            long = end - first > k
            parts.append(mix64(clean.word_hashes(first[long], first[long] + k) ^ np.uint64(k)))
            docs.append(doc[long])
    h, d, _ = sorted_sets(np.concatenate(parts), np.concatenate(docs), texts.n)
    sums = [np.concatenate([[0], np.cumsum(t[texts.data])])[texts.starts] for t in (_BANG, _STAR, _UPPER)]
    bang, star, upper = (np.diff(s) for s in sums)
    size = np.maximum(np.diff(texts.starts), 1)
    return h, d, np.stack([bang * 50 > size, star * 50 > size, upper * 4 > size], axis=1)


def label_model(votes: np.ndarray, start: np.ndarray, known: tuple[np.ndarray, np.ndarray] | None = None, rounds: int = 50) -> dict:
    """The model (prior, rates of both classes, covariance, shares) of 0/1 votes (rows x voters), by EM from a first guess of P(toxic) of each row.

    known are votes of rows of class 0 and of class 1: a prior of the rates, which together counts as much as the rows do.
    """
    weight = len(votes) / max(1, sum(map(len, known))) if known else 0.0
    extra = [(weight * v.sum(axis=0, dtype=np.float64), weight * len(v)) for v in known] if known else [(0.0, 0), (0.0, 0)]
    x, q = votes.astype(np.float64), start.astype(np.float64)
    for _ in range(rounds):
        prior = np.clip(q.mean(), 1e-3, 1 - 1e-3)
        rates = np.stack([(w @ x + 0.5 + n) / (w.sum() + 1 + m) for w, (n, m) in zip((1 - q, q), extra, strict=True)])
        rates = np.clip(rates, LEAST_RATE, 1 - LEAST_RATE)  # no voter settles a text alone
        c0, c1 = x - rates[0], x - rates[1]
        cov = ((c0 * (1 - q)[:, None]).T @ c0 + (c1 * q[:, None]).T @ c1) / len(x)
        sd = np.sqrt(np.diag(cov)) + 1e-6
        linked = np.abs(cov / sd[:, None] / sd[None, :])
        linked[linked < CORRELATED] = 0
        np.fill_diagonal(linked, 1)
        model = {"prior": prior, "rates": rates, "covariance": cov, "shares": 1 / linked.sum(axis=0)}  # k voters that always agree count as one
        new = posterior(votes, model)
        done = np.abs(new - q).max() < 1e-4
        q = new
        if done:
            break
    return model


def posterior(votes: np.ndarray, model: dict) -> np.ndarray:
    """P(toxic) of each row of votes."""
    low, high = model["rates"]
    fire, rest = np.log(high / low) * model["shares"], np.log((1 - high) / (1 - low)) * model["shares"]
    score = votes.astype(np.float64) @ (fire - rest) + rest.sum() + np.log(model["prior"] / (1 - model["prior"]))
    return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def _columns(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(46)).astype(np.int64)


def _linear(h: np.ndarray, d: np.ndarray, flags: np.ndarray, q: np.ndarray, epochs: int = 400) -> np.ndarray:
    """Weights (DIM, then PATTERNS, then the bias) of a logistic regression on soft labels, by full-batch AdaGrad with L2."""
    n, (used, col) = len(q), np.unique(_columns(h), return_inverse=True)
    m = len(used)
    w, seen = np.zeros(m + PATTERNS + 1), np.zeros(m + PATTERNS + 1) + 1e-8
    balance = np.where(q > 0.5, 0.5 / max(1e-9, (q > 0.5).mean()), 0.5 / max(1e-9, (q <= 0.5).mean())) if 0 < (q > 0.5).sum() < n else np.ones(n)
    f = flags.astype(np.float64)
    for _ in range(epochs):
        z = np.bincount(d, weights=w[col], minlength=n) + f @ w[m:-1] + w[-1]
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - q) * balance / n
        grad = np.concatenate([np.bincount(col, weights=g[d], minlength=m), g @ f, [g.sum()]])
        grad[:-1] += 1e-4 * w[:-1]
        seen += grad * grad
        w -= 0.5 * grad / np.sqrt(seen)
    out = np.zeros(DIM + PATTERNS + 1)
    out[used], out[DIM:] = w[:m], w[m:]
    return out


_SAMPLED = "id long, toxic int, loose boolean, flags array<int>, hashes array<long>"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, texts in doc_texts(batch.column(3)):
            h, d, f = features(texts)
            at = np.searchsorted(d, np.arange(end - row + 1)).astype(np.int32)
            flags = pa.FixedSizeListArray.from_arrays(pa.array(f.astype(np.int32).ravel()), PATTERNS).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(row, end - row) for i in range(3)), flags, pa.ListArray.from_arrays(pa.array(at), pa.array(h.view(np.int64)))], ["id", "toxic", "loose", "flags", "hashes"])


def sampled(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, sample: int = SAMPLE, unlabelled: int = UNLABELLED) -> DataFrame:
    """(id, toxic, loose, flags, hashes) of the two samples: toxic is null without label, loose says that the row is one of the unlabelled sample.

    Only rows whose crc32(id) mod folds is not 0; of a repeated id the text of the least hash.
    """
    learn = F.crc32(F.col("id").cast("string").cast("binary")) % folds != 0
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IS NOT NULL").where(learn)
    marks = marks.groupBy("id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    first = lambda df, n: df.withColumn("order", F.xxhash64("id")).orderBy("order", "id").limit(n).drop("order")
    there = rows.select("id").where("id IS NOT NULL").where(learn)
    loose = first(there.distinct(), unlabelled).select("id", F.lit(None).cast("int").alias("toxic"), F.lit(True).alias("loose"))
    ids = loose
    for value in (1, 0):
        ids = ids.unionByName(first(marks.where(F.col("toxic") == value), sample).withColumn("loose", F.lit(False)))
    ids = ids.groupBy("id").agg(F.max("toxic").alias("toxic"), F.max("loose").alias("loose"))
    # at most 2 * sample + unlabelled rows
    rows = rows.join(F.broadcast(materialise(ids, "toxicity-ids")), "id").groupBy("id", "toxic", "loose").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return materialise(rows.mapInArrow(trimmed(_features), _SAMPLED), "toxicity-features")


def mined_voters(rows: DataFrame) -> np.ndarray:
    """The hashes of lexicon voters: by log-odds in the labelled rows, with at least 5 toxic texts and 20 times the rate of others."""
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = rows.select("toxic", F.explode("hashes").alias("hash")).groupBy("hash").agg(F.sum("toxic").alias("hits"), F.sum(1 - F.col("toxic")).alias("miss"))
    odds = F.log((F.col("hits") + 0.5) / max(1, n.get(1, 0))) - F.log((F.col("miss") + 0.5) / max(1, n.get(0, 0)))
    best = counts.withColumn("odds", odds).where(f"hits >= 5 AND odds > {float(np.log(20))}").orderBy(F.desc(F.col("hits") * F.col("odds")), "hash").limit(VOTERS)
    return np.sort(np.array([r.hash for r in best.select("hash").collect()], np.int64).view(np.uint64))


def _only(kept: np.ndarray):
    """(id, toxic, loose, flags, hashes) with those hashes that are in kept (sorted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            h, at = np.asarray(lists.flatten(), np.int64).view(np.uint64), np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths(), np.int64))])
            place = np.minimum(np.searchsorted(kept, h), max(0, len(kept) - 1))
            hit = kept[place] == h if len(kept) else np.zeros(len(h), bool)
            ends = np.concatenate([[0], np.cumsum(hit)])[at].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.ListArray.from_arrays(pa.array(ends), pa.array(h[hit].view(np.int64)))], ["id", "toxic", "loose", "flags", "hashes"])

    return run


def _collected(rows: DataFrame, kept: np.ndarray) -> tuple[np.ndarray, ...]:
    """id, toxic (-1: none), loose, flags, and the kept hashes with their rows, by id."""
    t = rows.mapInArrow(_only(kept), _SAMPLED).toArrow().combine_chunks().sort_by("id").combine_chunks()
    lists = t["hashes"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    lengths = np.asarray(lists.value_lengths(), np.int64)
    flags = np.array(t["flags"].to_pylist(), np.int64).reshape(-1, PATTERNS)
    return np.asarray(t["id"], np.int64), np.asarray(t["toxic"].fill_null(-1), np.int64), np.asarray(t["loose"]), flags, np.asarray(lists.flatten(), np.int64).view(np.uint64), np.repeat(np.arange(len(lengths)), lengths)


def fit(rows: DataFrame) -> np.ndarray:
    """The classifier's weights from sampled() rows; without labels of both kinds, a constant score."""
    w = np.zeros(DIM + PATTERNS + 1)
    have = {r[0] for r in rows.where("toxic IS NOT NULL").select("toxic").distinct().collect()}
    if len(have) < 2:
        w[-1] = 30.0 if have == {1} else -30.0
        return w
    mine = rows.where("toxic IS NOT NULL").where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)) == 0)
    lexicon = mined_voters(mine)
    ids, toxic, loose, flags, h, d = _collected(rows, lexicon)
    mining = np.isin(ids, np.asarray(mine.select("id").toArrow()["id"], np.int64))  # at most 2 * sample ids
    votes = np.zeros((len(ids), len(lexicon) + PATTERNS), np.float32)
    votes[d, np.searchsorted(lexicon, h)] = 1
    votes[:, len(lexicon) :] = flags
    if len(lexicon):
        spoken = votes[:, : len(lexicon)].any(axis=1)
        known = tuple(votes[(toxic == k) & ~mining] for k in (0, 1))
        q = posterior(votes, label_model(votes[loose], np.where(spoken[loose], 0.9, 0.02), known))
    else:  # no word tells the labels apart: there is nothing to model
        q = np.where(toxic == 1, 0.9, 0.1)
    # features that the posteriors tell apart: the others, most of them, would only be learned by heart
    given = rows.sparkSession.createDataFrame(pa.table({"id": ids, "q": q}))
    p = float(q.mean())
    counts = rows.select("id", F.explode("hashes").alias("hash")).join(F.broadcast(given), "id").groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("hits"))
    far = F.abs(F.col("hits") - F.col("n") * p)
    told = counts.where((F.col("n") >= 3) & (far > Z * F.sqrt(F.col("n") * p * (1 - p) + 1e-9)) & (far > 2)).select("hash").toArrow()
    told = np.sort(np.asarray(told["hash"], np.int64).view(np.uint64))
    _, _, _, flags, h, d = _collected(rows, told)
    return _linear(h, d, flags, q)


def _score(weights: np.ndarray):
    w = weights.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, texts in doc_texts(batch.column(1)):
                h, d, f = features(texts)
                z = np.bincount(d, weights=w[_columns(h)], minlength=end - row) + f @ w[DIM:-1] + w[-1]
                score = 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(score)], ["doc_id", "score"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, sample: int = SAMPLE, unlabelled: int = UNLABELLED) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Scores depend on the text alone. Null and empty texts get the score of a text without words. Labels without id or value
    are ignored, a repeated id is toxic if any of its labels says so. Repeated rows each get their row; ids must be integers or read as such; an
    empty table gives none. Without labels of both kinds the score is constant.
    """
    weights = fit(sampled(docs, labels, id_col=id_col, text_col=text_col, folds=folds, sample=sample, unlabelled=unlabelled))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))
    out = rows.mapInArrow(trimmed(_score(weights)), "doc_id long, score double")
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
