"""Intermediate tables and files, in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..shared import scratch, shared_root

__all__ = ["materialize", "open_fs", "scratch", "shared_root", "small_batches"]


def materialize(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Write and reread: cuts the lineage, and a lost executor costs nothing that was written."""
    out = scratch(df.sparkSession, tag)
    df.write.option("compression", compression).parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def open_fs(uri: str):
    """(pyarrow file system, path in it) for use on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """From now on the session sends at most ``rows`` rows at a time to Python: a batch of texts is held by the JVM and by the worker
    at once, and plans read this setting when they run."""
    if int(spark.conf.get(BATCH)) > rows:
        spark.conf.set(BATCH, str(rows))
