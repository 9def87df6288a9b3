"""Intermediate tables in the shared folder that the session names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder's path below spark.checkpoint.dir. Where that is unset, a local folder serves a local session; a cluster has none."""
    conf = spark.sparkContext.getConf()
    base = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not base:
        if not (conf.get("spark.master") or "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "/tmp/lodestone-work"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, within: str | None = None) -> DataFrame:
    """df written to the shared folder, or below the folder within, and read back: short lineage that survives lost executors."""
    path = f"{within}/{what}-{uuid.uuid4().hex}" if within else shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of tables that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file beside its place and renames it; False, and no change, where the place is taken. Readers see all of it or nothing."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(conf)
    place = fs.makeQualified(place)
    fs.mkdirs(place.getParent())
    beside = jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(beside, place, spark.sparkContext._gateway.new_array(kind, 0))
        return True
    except Exception as e:
        fs.delete(beside, False)
        if "exist" in str(e).lower():
            return False
        raise


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    file = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(place)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
    finally:
        file.close()


def names_in(spark: SparkSession, folder: str, suffix: str = "") -> list[str]:
    """The names in a folder that end with suffix, without it, and don't start with a dot; none if there is no folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(n.removesuffix(suffix) for n in names if n.endswith(suffix) and not n.startswith("."))
