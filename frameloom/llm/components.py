"""Connected components of an edge table: by joins, or of a few edges by union-find in the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import store
from .skew import FEW_ROWS, meet


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, root): for each node of ``edges(a, b)`` the smallest node that it reaches.

    Large-star and small-star steps alternate (Kiveris et al., 2014): each replaces the edge table by one that
    joins nodes to smaller ones, until all edges point to a root. A step is a grouped minimum and a join, in which a node
    with a large part of all edges is met by sending its minimum to them; every step is written to the shared folder,
    so lineage stays short. Neighbour lists are never gathered. Only counts and fewer than ``skew.HOT`` nodes come to the driver.

    At most ``skew.FEW_ROWS`` edges come to the driver instead: each round of joins is some ten jobs, however few rows there are. Only
    the way depends on the count, not the rows.
    """
    edges = store.materialize(_oriented(edges), tag)
    seen, n = None, edges.count()
    if 0 < n <= FEW_ROWS:
        return _of_few(edges)
    while n:
        # each edge from its smaller node's view, with the least node that this one is joined to
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        ups = edges.groupBy("b").agg(F.count("*").alias("n")).withColumnRenamed("b", "via")
        ups = ups.join(least.withColumnRenamed("a", "via"), "via", "left").withColumn("m", F.coalesce("m", "via"))
        large = meet(edges.withColumnRenamed("b", "via"), ups, ["via"], n).select("a", F.col("m").alias("b"))
        large = store.materialize(_oriented(large), tag)
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = meet(large, least, ["a"], large.count()).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = store.materialize(_oriented(small), tag)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == seen:
            break
        seen, n = now, now["n"]
    own = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(own)


def _of_few(edges: DataFrame) -> DataFrame:
    held = edges.toArrow()
    nodes, at = np.unique(np.concatenate([held.column(c).to_numpy() for c in ("a", "b")]), return_inverse=True)
    root = list(range(len(nodes)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, j in at.reshape(2, -1).T.tolist():
        i, j = find(i), find(j)
        root[max(i, j)] = min(i, j)  # nodes ascend, so the least number is the smallest node
    kind = edges.schema["a"].dataType.simpleString()
    return edges.sparkSession.createDataFrame(pa.table({"node": nodes, "root": nodes[[find(i) for i in root]]}), f"node {kind}, root {kind}")


def _oriented(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger node ``a`` to the smaller ``b``."""
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
