"""Mixing sources to target weights by capped water-filling.

Targets: every source gets the whole budget's share by its weight; a source above its cap (at most
MAX_EPOCHS times its size) is clamped, and the excess is shared again by weight among the others until
none is above. Sampling: with r = target / size, each document is taken floor(r) times, and some of them
once more. These are chosen so that words, not documents, come out right: the source's documents are
parted by size (powers of two) and into BINS bins by a seeded hash; from the largest size class to the
smallest, the bins up to the one that comes nearest to the class's share plus what the classes before
have left over are taken. Only counts by source, class and bin (64 x BINS rows a source at most) are
gathered, so the plan is one scan and one small join, and reruns agree on any cluster.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialise, maybe_broadcast

MAX_EPOCHS, SEED, BINS = 3, 20240229, 128
WORD = r"[^\x20\x09-\x0D]+"


def water_fill(sizes: list[float], weights: list[float], budget: float, max_epochs: float = MAX_EPOCHS) -> list[float]:
    """Targets that add up to budget (or to all caps, if these are less), by weight, none above its cap."""
    caps, target = [max_epochs * s for s in sizes], [0.0] * len(sizes)
    free, left = set(range(len(sizes))), float(budget)
    while free:
        total = sum(weights[i] for i in sorted(free))
        for i in free:
            target[i] = left * weights[i] / total
        over = sorted(i for i in free if target[i] > caps[i])
        if not over:
            break
        for i in over:
            target[i] = float(caps[i])
            left -= caps[i]
        free -= set(over)
    return target


def _choose(bins: pd.DataFrame) -> pd.DataFrame:
    """The last bin of each size class whose documents are taken once more."""
    rows, carry = [], 0.0
    for kind, part in sorted(bins.groupby("kind"), key=lambda x: -x[0]):
        part = part.sort_values("bin")
        want = float(part["part"].iloc[0]) * float(part["words"].sum()) + carry
        ends = [0.0, *part["words"].cumsum().astype(float)]
        k = min(range(len(ends)), key=lambda i: (abs(ends[i] - want), i))
        carry = want - ends[k]
        rows.append((bins["key"].iloc[0], kind, int(part["bin"].iloc[k - 1]) if k else -1))
    return pd.DataFrame(rows, columns=["key", "kind", "last"])


def source_targets(sized: DataFrame, *, max_epochs: float = MAX_EPOCHS, weights: dict[str | None, float] | None = None) -> DataFrame:
    """(key, source_size, target, whole, part) of each source. sized: (key, size); key is the source after 's', or 'n' for null.

    Without weights, sources by code point with null last weigh 1, 2, 3, repeating. One row a source
    comes to the driver.
    """
    totals = sorted((r.key, r.words) for r in sized.groupBy("key").agg(F.sum("size").alias("words")).collect())
    totals = [x for x in totals if x[0] != "n"] + [x for x in totals if x[0] == "n"]
    w = [1.0 + i % 3 if weights is None else weights[None if k == "n" else k[1:]] for i, (k, _) in enumerate(totals)]
    sizes = [float(s) for _, s in totals]
    rows = []
    for (key, size), target in zip(totals, water_fill(sizes, w, sum(sizes), max_epochs), strict=True):
        r = min(target / size, max_epochs) if size else 0.0
        rows.append((key, int(size), target, int(r), r - int(r)))
    return sized.sparkSession.createDataFrame(rows, "key string, source_size long, target double, whole int, part double")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> dict[str, Column]:
    source = F.col(f"`{source_col}`").cast("string")
    size = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long")
    return {
        "key": F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source)),
        "size": size,
        "bin": F.pmod(F.xxhash64(F.lit(seed), F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`")), F.lit(BINS)).cast("int"),
    }


_KIND = "if(size > 0, cast(floor(log2(size)) AS int), -1) AS kind"


def _plan(sized: DataFrame, max_epochs: float, weights: dict | None) -> tuple[DataFrame, DataFrame]:
    """Targets by source, and the last bin taken once more by source and size class."""
    bins = sized.selectExpr("key", _KIND, "bin", "size").groupBy("key", "kind", "bin").agg(F.sum("size").alias("words"))
    bins = materialise(bins, "bins")
    targets = source_targets(bins.withColumnRenamed("words", "size"), max_epochs=max_epochs, weights=weights)
    last = bins.join(maybe_broadcast(targets.select("key", "part")), "key").groupBy("key").applyInPandas(_choose, "key string, kind int, last int")
    return targets, materialise(last, "cuts")


def _with_times(rows: DataFrame, targets: DataFrame, last: DataFrame) -> DataFrame:
    rows = rows.join(maybe_broadcast(targets), "key").join(maybe_broadcast(last), ["key", "kind"])
    return rows.withColumn("times", F.expr("whole + if(bin <= last, 1, 0)"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_epochs: float = MAX_EPOCHS, seed: int = SEED, weights: dict | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (size times the copies that the mix takes).

    Null and empty texts have size 0; documents without source form one source, the last one. Repeated
    rows share their hash and so their number of copies; ties in size do not matter. An empty table gives none.
    """
    parts = _sized(docs, id_col, text_col, source_col, seed)
    sized = materialise(docs.select(F.col(id_col).alias("doc_id"), *[c.alias(k) for k, c in parts.items()]), "sizes")
    out = _with_times(sized.selectExpr("*", _KIND), *_plan(sized, max_epochs, weights))
    return out.selectExpr("doc_id", "size", "source_size", "target", "size * times AS taken")


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_epochs: float = MAX_EPOCHS, seed: int = SEED, weights: dict | None = None) -> DataFrame:
    """docs with every row as often as the mix takes it."""
    parts = _sized(docs, id_col, text_col, source_col, seed)
    plan = _plan(docs.select(*[c.alias(k) for k, c in parts.items()]), max_epochs, weights)
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    out = _with_times(docs.select(doc, *[c.alias(k) for k, c in parts.items()]).selectExpr("*", _KIND), *plan)
    copies = free_name(docs.columns, "copy")
    return out.where("times > 0").select("doc.*", F.explode(F.expr("sequence(1, times)")).alias(copies)).drop(copies)
