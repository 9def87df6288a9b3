"""Entities, documentation and chunks of source files as DataFrames; texts are parsed in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import comments, parse, split


def _explode(files: DataFrame, kind: str, f: Callable[[str, str, str], list], keep: list[str]) -> DataFrame:
    @F.pandas_udf(f"array<{kind}>")
    def rows(path: pd.Series, language: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([f(p or "", g or "", t or "") for p, g, t in zip(path, language, text, strict=True)])

    out = files.select(*keep, F.posexplode(rows("path", "language", "content")).alias("seq", "_r"))
    return out.select(*keep, "seq", "_r.*")


def entities(files: DataFrame, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """(keep, path, language, seq, parse.ROW's fields) of files (path, language, content); unreadable texts give no rows."""
    return _explode(files, parse.ROW, lambda _, g, t: parse.parse(g, t), [*keep, "path", "language"])


def angular_entities(files: DataFrame) -> DataFrame:
    return _explode(files, parse.ROW, lambda _, __, t: parse.angular(t), ["path"])


def solutions(files: DataFrame) -> DataFrame:
    """(path, project, project_path, guid) of .sln files."""
    rows = _explode(files, parse.ROW, lambda _, __, t: parse.solution(t), ["path"])
    return rows.select("path", F.col("name").alias("project"), F.col("type").alias("project_path"), F.col("doc").alias("guid"))


def documentation(files: DataFrame, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """(keep, path, language, seq, kind, name, text, returns, params) of comments and docstrings."""
    return _explode(files, comments.ROW, lambda _, g, t: comments.read(g, t), [*keep, "path", "language"])


def chunks(files: DataFrame, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """(keep, chunk_id, path, language, chunk_no, type, name, content) by each language's structure, or by the line packer."""
    rows = _explode(files, split.ROW, lambda _, g, t: split.split(g, t), [*keep, "path", "language"])
    return rows.select(*keep, F.concat_ws("_chunk_", "path", "seq").alias("chunk_id"), "path", "language", F.col("seq").alias("chunk_no"), "type", "name", "content")


def file_results(files: DataFrame) -> DataFrame:
    """(path, language, entities, documentation, chunks): all that one pass over a file finds, in one row."""
    kind = f"struct<entities:array<{parse.ROW}>,documentation:array<{comments.ROW}>,chunks:array<{split.ROW}>>"

    @F.pandas_udf(kind)
    def every(language: pd.Series, text: pd.Series) -> pd.DataFrame:
        found = [(parse.parse(g or "", t or ""), comments.read(g or "", t or ""), split.split(g or "", t or "")) for g, t in zip(language, text, strict=True)]
        return pd.DataFrame(found, columns=["entities", "documentation", "chunks"])

    return files.select("path", "language", every("language", "content").alias("_r")).select("path", "language", "_r.*")
