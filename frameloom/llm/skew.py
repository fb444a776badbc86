"""Joins whose keys may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

HOT = 512
FEW_ROWS, SALTS = 10_000, 32


def meet(rows: DataFrame, groups: DataFrame, keys: list[str], total: int, n: str = "n", how: str = "inner") -> DataFrame:
    """``rows`` joined on ``keys`` (not null) with ``groups``, which has one row for each key and in ``n`` the number of its rows in ``rows``; ``total``
    is that of all. Keys that hold more than 1 / HOT of the rows, and so are fewer than HOT, are collected and sent to their rows; the
    others are exchanged, at most 1 / HOT of the rows to each key. The result has the columns of both but ``n``."""
    hot = groups.filter(F.col(n) > total / HOT).drop(n)
    found = hot.toArrow()
    groups = groups.filter(F.col(n) <= total / HOT).drop(n)
    if not found.num_rows:
        return rows.join(groups, keys, how)
    hot = rows.sparkSession.createDataFrame(found, hot.schema)
    warm = rows.join(F.broadcast(hot), keys)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(groups, keys, how)
    return warm.unionByName(cold)


def look_up(rows: DataFrame, table: DataFrame, keys: dict[str, str], spread: list[str], n: int) -> DataFrame:
    """``rows`` left-joined with the ``n`` rows of ``table`` where the columns ``keys`` (row's name to table's) are equal, null to null; the table's key
    columns go. A small table is sent to all; a larger one is met in SALTS parts, each with the rows whose ``spread`` columns fall to it. Only
    the way depends on ``n``, not the result."""
    same = F.lit(True)
    for own, other in keys.items():
        same = same & F.col(own).eqNullSafe(F.col(other))
    if n <= FEW_ROWS:
        return rows.join(F.broadcast(table), same, "left").drop(*keys.values())
    parts = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_salted", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    return salted.join(parts, same & (F.col("_salted") == F.col("_salt")), "left").drop("_salt", "_salted", *keys.values())
