"""Keyed Parquet tables with upsert, append, delete and replacement; readers see one whole version."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.storage import create_once, names_in, read_text


class Conflict(RuntimeError):
    """Another writer has made the same version."""


class Table:
    """Parts below data/, and versions/vN.json, the list of parts that make up version N.

    Rows are dealt to parts by a label: the value of the column by, or one of buckets hash buckets of the keys. A change writes new
    parts only for the labels that it touches, and then creates the next version's file, which fails if another writer was first; the change is
    then made again on that writer's version. Old versions stay until vacuum().
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], *, by: str | None = None, buckets: int = 16):
        self.spark, self.path, self.keys, self.by, self.buckets = spark, path.rstrip("/"), keys, by, buckets
        self._jvm = spark.sparkContext._jvm
        self._at = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- versions
    def versions(self) -> list[int]:
        return sorted(int(n[1:]) for n in names_in(self.spark, f"{self.path}/versions", ".json"))

    def _load(self, version: int | None = None) -> dict:
        have = self.versions()
        if not have and version is None:
            return {"version": 0, "schema": None, "parts": []}
        version = have[-1] if version is None else version
        return json.loads(read_text(self.spark, f"{self.path}/versions/v{version}.json")) | {"version": version}

    def _commit(self, before: dict, schema: StructType, parts: list[list[str]]) -> None:
        version = before["version"] + 1
        if not create_once(self.spark, f"{self.path}/versions/v{version}.json", json.dumps({"schema": schema.json(), "parts": parts})):
            raise Conflict(f"version {version} of {self.path}")

    def _change(self, make: Callable[[dict], tuple[StructType, list[list[str]]] | None], tries: int = 5) -> None:
        for left in range(tries, 0, -1):
            before = self._load()
            made = make(before)
            if made is None:
                return
            try:
                return self._commit(before, *made)
            except Conflict:
                if left == 1:
                    raise

    # --- parts
    def _label(self) -> Column:
        return F.coalesce(F.col(self.by).cast("string"), F.lit("")) if self.by else F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("string")

    def _write(self, rows: DataFrame) -> list[list[str]]:
        """New parts [label, folder] of the rows; files are below one folder for each label."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn("_label", F.concat(F.lit("x"), self._label())).write.partitionBy("_label").parquet(f"{self.path}/{folder}")
        unescape = self._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(f"{self.path}/{folder}")) if s.isDirectory()]
        return [[unescape(n.removeprefix("_label="))[1:], f"{folder}/{n}"] for n in names if n.startswith("_label=")]

    def _frame(self, state: dict, labels: set[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(state["schema"]))
        places = [f"{self.path}/{p}" for label, p in state["parts"] if labels is None or label in labels]
        if not places:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*places)

    def read(self, version: int | None = None, *, labels: list[str] | None = None) -> DataFrame:
        """The table, or only the parts of some labels."""
        state = self._load(version)
        if state["schema"] is None:
            raise ValueError(f"{self.path} has no version")
        return self._frame(state, None if labels is None else set(labels))

    def _touched(self, rows: DataFrame) -> set[str]:
        """At most as many labels as there are buckets, or values of by."""
        return {r[0] for r in rows.select(self._label()).distinct().collect()}

    # --- changes
    def overwrite(self, df: DataFrame) -> None:
        new = self._write(df)
        self._change(lambda before: (df.schema, new))

    def replace(self, label: str, df: DataFrame) -> None:
        """Puts df in place of all rows with the label (a value of by)."""
        new = self._write(df)
        self._change(lambda before: (self._widened(before, df), [p for p in before["parts"] if p[0] != label] + new))

    def append(self, rows: DataFrame) -> None:
        """Adds rows; nothing that is there is read or written again."""
        new = self._write(rows)
        self._change(lambda before: (self._widened(before, rows), before["parts"] + new))

    def _widened(self, before: dict, rows: DataFrame) -> StructType:
        if before["schema"] is None:
            return rows.schema
        old = StructType.fromJson(json.loads(before["schema"]))
        have = {f.name.lower() for f in old}
        return StructType([*old, *(f for f in rows.schema if f.name.lower() not in have)])

    def upsert(self, rows: DataFrame) -> None:
        """Sets the given columns of the rows' keys and keeps all others; of rows with the same key any one counts."""
        rows = rows.dropDuplicates(self.keys)

        def make(before: dict):
            if before["schema"] is None:
                return rows.schema, self._write(rows)
            touched, schema = self._touched(rows), self._widened(before, rows)
            old = self._frame(before | {"schema": schema.json()}, touched)
            new = rows.select(*self.keys, *[F.col(c).alias(f"_new_{c}") for c in rows.columns if c not in self.keys], F.lit(True).alias("_given"))
            both = old.join(new, self.keys, "full")
            cells = [F.when(F.col("_given"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in rows.columns and c not in self.keys else F.col(c) for c in old.columns]
            return schema, [p for p in before["parts"] if p[0] not in touched] + self._write(both.select(*cells))

        self._change(make)

    def delete(self, where: Column) -> int:
        """Drops the rows for which where is true; the number of them. Only parts that have such rows are written again."""
        gone = 0

        def make(before: dict):
            nonlocal gone
            if before["schema"] is None:
                return None
            old = self._frame(before)
            hits = old.where(where).groupBy(self._label().alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()
            gone = sum(r.n for r in hits)
            if not gone:
                return None
            touched = {r.label for r in hits}
            kept = self._frame(before, touched).where(~F.coalesce(where, F.lit(False)))
            return old.schema, [p for p in before["parts"] if p[0] not in touched] + self._write(kept)

        self._change(make)
        return gone

    def clear(self) -> None:
        self._change(lambda before: (StructType.fromJson(json.loads(before["schema"])), []) if before["schema"] else None)

    def vacuum(self) -> None:
        """Removes all versions but the last, and the folders that it doesn't use. Not while others write."""
        state = self._load()
        used = {"/".join(p.split("/")[:2]) for _, p in state["parts"]}
        for v in self.versions()[:-1]:
            self._fs.delete(self._at(f"{self.path}/versions/v{v}.json"), False)
        if self._fs.exists(self._at(f"{self.path}/data")):
            for s in self._fs.listStatus(self._at(f"{self.path}/data")):
                if f"data/{s.getPath().getName()}" not in used:
                    self._fs.delete(s.getPath(), True)
