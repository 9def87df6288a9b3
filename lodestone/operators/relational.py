"""Filters, joins, set operations and keyed reductions that the analyses share."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import glob_regex


# --- filters
def payload_filter(conditions: dict[str, Any]) -> Column:
    """All conditions: a list means one of its values, anything else equality. Null never matches."""
    each = [F.col(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(k) == F.lit(v) for k, v in conditions.items()]
    return reduce(lambda a, b: a & b, each, F.lit(True))


def optional_filter(df: DataFrame, **values: Any) -> DataFrame:
    """Equality only for the parameters that are given."""
    return df.where(payload_filter({k: v for k, v in values.items() if v}))


CODE_KINDS = ("class", "interface", "method", "function")


def search_type_filter(search_type: str = "all", *, code_type: str | None = None, chunk_type: str | None = None, column: str = "type", exact_file: bool = False) -> Column:
    """The kind of row that a search is for; code means any kind of code, or only whole files with exact_file."""
    kind = F.col(column)
    if search_type == "code":
        if code_type:
            return kind == code_type if code_type in CODE_KINDS else F.lit(True)
        return kind == "file" if exact_file else kind.isin("file", *CODE_KINDS)
    if search_type == "documentation":
        return kind == "documentation"
    if search_type == "chunks":
        return kind == chunk_type if chunk_type else F.lit(True)
    if search_type != "all":
        raise ValueError(f"unknown search type: {search_type}")
    return F.lit(True)


def same_text(column: Column, value: str) -> Column:
    return F.lower(column) == value.lower()


def without_substrings(column: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [~F.contains(column, F.lit(p)) for p in parts], F.lit(True))


def without_globs(column: Column, globs: list[str]) -> Column:
    path = F.replace(column, F.lit("\\"), F.lit("/"))
    return ~path.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs)) if globs else F.lit(True)


def exact_else_partial(df: DataFrame, column: str, name: str, limit: int, order: list[str]) -> DataFrame:
    """Rows equal to name; only if there are none, the first that contain it in any case."""
    exact = df.where(F.col(column) == name)
    partial = df.where(F.contains(F.lower(F.col(column)), F.lit(name.lower()))).orderBy(*order).limit(limit)
    none = exact.limit(1).agg(F.count(F.lit(1)).alias("_found")).where("_found = 0")
    return exact.unionByName(partial.join(F.broadcast(none), how="cross").drop("_found"))


def first_by_priority(parts: list[DataFrame], order: list[str]) -> DataFrame:
    """The first row of the first part that has any."""
    every = reduce(DataFrame.unionByName, [p.withColumn("_rank", F.lit(i)) for i, p in enumerate(parts)])
    return every.orderBy("_rank", *order).limit(1).drop("_rank")


def top_with_rest(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key, with the number of rows beyond them as more."""
    w = Window.partitionBy(key)
    out = df.withColumn("rank", F.row_number().over(w.orderBy(*order)).cast("long"))
    return out.where(F.col("rank") <= n).join(df.groupBy(key).agg((F.greatest(F.count(F.lit(1)) - n, F.lit(0))).alias("more")), key)


# --- keyed reductions
def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes last; map-side combined, so a hot key costs one row a task."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return df.groupBy(*keys).agg(pick).select(*keys, "_last.*")


def merge_attributes(df: DataFrame, key: str, order: str) -> DataFrame:
    """Each key's attributes: of every column the last value that is not null."""
    return df.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in df.columns if c not in (key, order)])


def dependency_sets(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(src, dependencies): sorted and distinct, without the node itself."""
    rows = edges.where(F.col(src) != F.col(dst))
    return rows.groupBy(src).agg(F.array_sort(F.collect_set(dst)).alias("dependencies"))


def dependency_lists(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(src, dst, n): each dependency with the number of its repeats, without the node itself; a list as a multiset, which no hot node can blow up."""
    return edges.where(F.col(src) != F.col(dst)).groupBy(src, dst).agg(F.count(F.lit(1)).alias("n"))


# --- joins
def related_entities(edges: DataFrame, entity: str, first: DataFrame, second: DataFrame, *, direction: str = "both", kind: str | None = None, limit: int = 100) -> DataFrame:
    """(id, name, kind, direction) of an entity's neighbours, looked up in first, else in second (id, name); unknown ones are dropped."""
    if direction not in ("in", "out", "both"):
        raise ValueError(f"unknown direction: {direction}")
    out = edges.where(F.col("src") == entity).select(F.col("dst").alias("id"), F.col("type").alias("kind"), F.lit("out").alias("direction"))
    into = edges.where(F.col("dst") == entity).select(F.col("src").alias("id"), F.col("type").alias("kind"), F.lit("in").alias("direction"))
    near = {"out": out, "in": into}.get(direction, out.unionByName(into))
    if kind:
        near = near.where(F.col("kind") == kind)
    known = near.join(first.select("id", F.col("name").alias("_a")), "id", "left").join(second.select("id", F.col("name").alias("_b")), "id", "left")
    known = known.select("id", F.coalesce("_a", "_b").alias("name"), "kind", "direction").where("name IS NOT NULL")
    return known.orderBy("direction", "id", "kind").limit(limit)


def add_missing(nodes: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """nodes, and the wanted rows whose key they don't have."""
    new = wanted.join(nodes.select(key), key, "left_anti").dropDuplicates([key])
    return nodes.unionByName(new, allowMissingColumns=True)


def by_precedence(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """All rows of the first part, and of every further one those whose keys no part before it has; of a part's repeats the first by the other columns."""
    every = reduce(DataFrame.unionByName, [p.withColumn("_rank", F.lit(i)) for i, p in enumerate(parts)])
    rest = [c for c in every.columns if c not in keys and c != "_rank"]
    first = F.min_by(F.struct(*rest), F.struct("_rank", *rest)).alias("_first")
    return every.groupBy(*keys).agg(first).select(*keys, "_first.*")


def latest_checkpoint(df: DataFrame, name: str = "name") -> DataFrame:
    """The row whose name (checkpoint_COUNT_...) has the largest count; by number, not by text, and the last by name among equals."""
    count = F.regexp_extract(name, r"^checkpoint_(\d+)", 1)
    return df.where(count != "").orderBy(F.desc(count.cast("long")), F.desc(name)).limit(1)


def unprocessed(candidates: DataFrame, done: DataFrame, failed: DataFrame | None = None, key: str = "path") -> DataFrame:
    seen = done.select(key) if failed is None else done.select(key).union(failed.select(key))
    return candidates.join(seen.distinct(), key, "left_anti")


def existing(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key other has."""
    return df.join(other.select(key), key, "left_semi")


def union_distinct(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).distinct()


def first_n(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def first_match(left: DataFrame, right: DataFrame, on: str, key: str, order: list[str]) -> DataFrame:
    """Each left row with the first right row of the same value; left rows without one stay."""
    first = right.groupBy(on).agg(F.min_by(F.struct(*[c for c in right.columns if c != on]), F.struct(*order)).alias("_first"))
    return left.join(first.select(on, "_first.*"), on, "left")


# --- patterns of hits
def confidence_rank(column: str = "confidence") -> Column:
    return F.when(F.col(column) == "high", 0).when(F.col(column) == "medium", 1).otherwise(2)


def dedup_patterns(hits: DataFrame) -> DataFrame:
    """(name, confidence, count, first_seq) of hits (name, confidence, source, seq), map-side combined; pattern_sources() has the sources.

    Confidence is high if any later hit's is or there are more than two, else the first hit's.
    """
    grouped = hits.groupBy("name").agg(
        F.count(F.lit(1)).alias("count"), F.max(F.col("confidence") == "high").alias("_high"), F.min_by("confidence", "seq").alias("_first"), F.min("seq").alias("first_seq"),
    )
    return grouped.select("name", F.when(F.col("_high") | (F.col("count") > 2), "high").otherwise(F.col("_first")).alias("confidence"), "count", "first_seq")


def pattern_sources(hits: DataFrame) -> DataFrame:
    """(name, seq, source): a pattern's sources with repeats, one row each, so that no group has to fit in a task."""
    return hits.select("name", "seq", "source")


def sort_patterns(patterns: DataFrame) -> DataFrame:
    return patterns.orderBy(confidence_rank(), F.desc("count"), "first_seq")
