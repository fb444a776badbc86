"""Counters of a run: measured while its rows are written, in the same pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F


def counted(df: DataFrame, **counters: Column) -> tuple[DataFrame, Observation]:
    """``df`` and what is known after its next action: rows, and for each counter the number of rows in which it is true."""
    seen = Observation()
    columns = [F.count(F.lit(1)).alias("rows"), *(F.count_if(c).alias(k) for k, c in counters.items())]
    return df.observe(seen, *columns), seen
