"""Where intermediate tables and files go: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, as a URI with a scheme. Where it is unset, a local session (one machine, as in tests) gets a
    temporary folder; on a cluster that raises."""
    root = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="frameloom-"))
        root = spark.sparkContext.getCheckpointDir()
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(path).toString().rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder, removed when the session's JVM ends."""
    out = f"{shared_root(spark)}/frameloom-{tag}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return out
