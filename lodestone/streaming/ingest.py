"""Incremental ingestion: what a source has got since the last run, exactly once, with a checkpoint in place of a file list."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def _stream(spark: SparkSession, source: str, files_per_batch: int) -> tuple[StructType, DataFrame]:
    """The schema of a folder or file of Parquet, and a stream of its files."""
    schema = spark.read.parquet(source).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        reader, source = reader.option("pathGlobFilter", at.getName()), at.getParent().toString()
    return schema, reader.parquet(source)


def copy_available(spark: SparkSession, source: str, target: str, *, files_per_batch: int = 1000) -> DataFrame:
    """Appends the Parquet files that are new below source to target/data, and returns that table.

    Run again, it takes up only files that came in between.
    """
    schema, stream = _stream(spark, source, files_per_batch)
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{target}/checkpoint").option("path", f"{target}/data").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(schema).parquet(f"{target}/data")


def upsert_available(spark: SparkSession, source: str, checkpoint: str, upsert: Callable[[DataFrame], None], *, files_per_batch: int = 1000) -> None:
    """Hands every micro-batch of new files to upsert, which must bear getting one twice."""
    _, stream = _stream(spark, source, files_per_batch)
    run = stream.writeStream.foreachBatch(lambda df, _: upsert(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
