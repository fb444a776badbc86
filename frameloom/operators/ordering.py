"""Places in a global order, without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BANDS = 64
DEALT, MOST_DEALT = 400_000, 4_000_000  # rows in a task, on average: while tasks are few, and at most


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` by its key in as many tasks as its rows need, DEALT in each, or as many as run at once. Up to Spark's threshold (200), writers
    of the exchange hold no rows, beyond it they sort them; so there are more only where a task would get MOST_DEALT. Adaptive execution would join tasks up to 64 MB of packed rows, some ten times that in memory."""
    context, rows = df.sparkSession.sparkContext, df.count()
    unsorted = int(context.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    return df.repartition(max(context.defaultParallelism, min(unsorted, -(-rows // DEALT)), -(-rows // MOST_DEALT)), key)


def bands(df: DataFrame, value: str, n: int = BANDS) -> Column:
    """The band of ``value``, a number, from 0: about as many rows of ``df`` in each of ``n``. Equal values share one; only the bounds come to the driver."""
    bounds = sorted(set(df.approxQuantile(value, [k / n for k in range(1, n)], 0.25 / n)))
    return sum((F.coalesce((F.col(value) > b).cast("int"), F.lit(0)) for b in bounds), F.lit(0))


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with ``name``, from 0 in the order of ``key``, a number that is unique and not null: each band is sorted by itself, and the sizes of the
    bands before it, one number for each, are added."""
    df = df.withColumn("_band", bands(df, key))
    sizes = df.groupBy("_band").agg(F.count("*").alias("_n"))
    before = sizes.select("_band", (F.sum("_n").over(Window.orderBy("_band")) - F.col("_n")).alias("_before"))  # a row for each band
    place = F.row_number().over(Window.partitionBy("_band").orderBy(key)) - 1
    return df.withColumn("_k", place).join(F.broadcast(before), "_band").withColumn(name, F.col("_k") + F.col("_before")).drop("_band", "_k", "_before")


def average_ranks(df: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """(by, value, ``name``): the rank of each distinct value within its group, from 1, ties sharing their mean. Values are counted, and the counts summed
    up band by band. Nulls have no rank."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_band", bands(counts, value))
    sizes = counts.groupBy(*by, "_band").agg(F.sum("_n").alias("_size"))
    before = sizes.select(*by, "_band", (F.sum("_size").over(Window.partitionBy(*by).orderBy("_band")) - F.col("_size")).alias("_before"))
    within = F.sum("_n").over(Window.partitionBy(*by, "_band").orderBy(value))
    placed = counts.withColumn("_upto", within).join(before, [*by, "_band"])
    return placed.select(*by, value, (F.col("_before") + F.col("_upto") - (F.col("_n") - 1) / 2).alias(name))
