"""Roll-ups of files, entities and patterns, all map-side combined aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def histogram(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """(column, n): counts of a column's values, the most frequent first, ties by value; only the first top ones if given."""
    out = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return out if top is None else out.orderBy(F.desc("n"), column).limit(top)


def paths_by(files: DataFrame, namespace: str, path: str) -> DataFrame:
    """(namespace, n_files, paths): sorted paths of each namespace; files without one are left out."""
    rows = files.where(F.coalesce(F.col(namespace), F.lit("")) != "")
    return rows.groupBy(namespace).agg(F.count(F.lit(1)).alias("n_files"), F.array_sort(F.collect_list(path)).alias("paths"))


def namespace_rollup(files: DataFrame, namespace: str, sums: dict[str, str]) -> DataFrame:
    """(namespace, n_files, sums): counted files and added-up columns (name: column) of each namespace, 'Unknown' where there is none."""
    key = F.coalesce(F.nullif(F.col(namespace), F.lit("")), F.lit("Unknown")).alias("namespace")
    return files.groupBy(key).agg(F.count(F.lit(1)).alias("n_files"), *[F.sum(c).alias(name) for name, c in sums.items()])


def kinds_by_file(entities: DataFrame, kinds: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys, n_<kind>...): entities of each kind in each file."""
    return entities.groupBy(*(keys or ["path"])).agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds])


def scan_summary(files: DataFrame, namespace: str, flags: dict[str, Column], marks: dict[str, Column]) -> DataFrame:
    """One row: files, namespaces (distinct), the number of files of each flag, and whether any file has each mark."""
    counts = [F.count_if(c).alias(name) for name, c in flags.items()]
    return files.agg(F.count(F.lit(1)).alias("files"), F.count_distinct(namespace).alias("namespaces"), *counts, *[F.coalesce(F.bool_or(c), F.lit(False)).alias(name) for name, c in marks.items()])


def distinct_values(files: DataFrame, key: str, column: str) -> DataFrame:
    """(key, values): the sorted distinct values of a column of few values, such as the languages of a repository."""
    return files.groupBy(key).agg(F.array_sort(F.collect_set(column)).alias("values"))


def repository_rollup(files: DataFrame, patterns: DataFrame, facts: DataFrame, key: str = "repo_id") -> DataFrame:
    """(key, n_files, languages, patterns, environment) of each repository: files (language), patterns (name), facts (key, as fact)."""
    out = files.groupBy(key).agg(F.count(F.lit(1)).alias("n_files"), F.array_sort(F.collect_set("language")).alias("languages"))
    names = distinct_values(patterns, key, "name").withColumnRenamed("values", "patterns")
    env = distinct_values(facts, key, "fact").withColumnRenamed("values", "environment")
    return out.join(names, key, "left").join(env, key, "left")
