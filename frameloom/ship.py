"""Sends this package to the executors, which may not have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once for each application: adds the package's sources as a zip that Spark serves to every executor."""
    context = spark.sparkContext
    if getattr(context, "_has_frameloom", False):
        return
    package = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="frameloom-")) / "frameloom-sources.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    context.addPyFile(str(out))
    # workers that the driver starts for itself, as those that prepare a stateful stream, don't get the files that executors are sent
    paths = [str(out), context.environment.get("PYTHONPATH", "")]
    context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, paths))
    context._has_frameloom = True
