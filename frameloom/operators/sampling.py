"""Sampling and splits: deterministic, by digest rank or by a seeded shuffle of the few groups on the driver."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .contracts import ContractError, _raise_if
from . import contracts
from .ordering import bands


def ranked(df: DataFrame, strata: list[str], key: str, seed: int) -> DataFrame:
    """``df`` with digest (SHA-256 of seed, zero byte, key) and place, from 1 by digest and key within a stratum. Larger samples hold smaller ones."""
    digest = F.sha2(F.concat(F.lit(f"{seed}\0"), F.col(key).cast("string")), 256)
    return df.withColumn("digest", digest).withColumn("place", F.row_number().over(Window.partitionBy(*strata).orderBy("digest", key)))


def by_strata(df: DataFrame, strata: list[str], key: str, k: int, seed: int) -> DataFrame:
    """k rows of each stratum; a stratum with fewer raises."""
    _raise_if(df.groupBy(*strata).count().filter(F.col("count") < k), f"every stratum needs {k} rows")
    return ranked(df, strata, key, seed).filter(F.col("place") <= k).drop("digest", "place")


def by_speaker(df: DataFrame, speaker: str, key: str, k: int, seed: int) -> DataFrame:
    """At most k rows of each speaker, by unique keys: sorted by key, then shuffled by Python's generator seeded with seed and speaker. Only keys
    are gathered by speaker."""
    keys = df.select(speaker, key)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        held = sorted(pdf[key].tolist())
        random.Random(f"{seed}:{pdf[speaker].iloc[0]}").shuffle(held)
        return pd.DataFrame({speaker: pdf[speaker].iloc[0], key: held[:k]})

    return df.join(keys.groupBy(speaker).applyInPandas(pick, keys.schema), [speaker, key], "left_semi").select(*df.columns)


def split_speakers(df: DataFrame, speaker: str, seed: int, fraction: float | None = None, count: int | None = None) -> DataFrame:
    """``df`` with split: development for the first speakers of a seeded shuffle (a rounded fraction, at least one and not all; or
    a count), else validation. Only the distinct speakers come to the driver."""
    names = sorted(r[0] for r in df.select(speaker).distinct().collect())
    random.Random(seed).shuffle(names)
    n = count if count is not None else min(max(round(len(names) * fraction), 1), len(names) - 1)
    if not 0 < n < len(names):
        raise ContractError("both sides of a split need speakers")
    chosen = df.sparkSession.createDataFrame([(x,) for x in names[:n]], f"{speaker} {df.schema[speaker].dataType.simpleString()}").withColumn("_d", F.lit(True))
    return df.join(chosen, speaker, "left").withColumn("split", F.when(F.col("_d"), "development").otherwise("validation")).drop("_d")


def coverage(df: DataFrame, strata: list[str], k: int) -> DataFrame:
    """One row: cells there are, cells of the full product of the strata's values, cells that don't hold k rows."""
    cells = df.groupBy(*strata).agg(F.count("*").alias("n"))
    product = F.lit(1).cast("long")
    for s in strata:
        product = product * F.countDistinct(s)
    return cells.agg(F.count("*").alias("cells"), product.alias("expected"), F.count_if(F.col("n") != k).alias("off"))


def first_utterances(df: DataFrame, key: str, ordinal: str, n: int) -> DataFrame:
    """All rows of the n keys that appear first."""
    first = df.groupBy(key).agg(F.min(ordinal).alias("_o")).orderBy("_o", key).limit(n).select(key)
    return df.join(F.broadcast(first), key, "left_semi") if n <= 100_000 else df.join(first, key, "left_semi")


def _lead(df: DataFrame, key: str) -> Column:
    """A number that ascends with ``key``: itself, or the first six bytes of a string."""
    if df.schema[key].dataType.simpleString() != "string":
        return F.col(key).cast("double")
    return F.conv(F.rpad(F.hex(F.substring(F.encode(key, "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")


def review_candidates(df: DataFrame, partition: str, key: str) -> DataFrame:
    """The first, middle and last key of each partition, each once. Keys are counted in bands, and only the bands that hold these places are sorted."""
    df = df.withColumn("_lead", _lead(df, key))
    df = df.withColumn("_band", bands(df, "_lead"))
    sizes = df.select(F.col(partition).alias("_p"), F.col("_band").alias("_b")).groupBy("_p", "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("_p")  # a row for each band
    sizes = sizes.withColumns({"_upto": F.sum("_n").over(w.orderBy("_b")), "_all": F.sum("_n").over(w)}).withColumn("_before", F.col("_upto") - F.col("_n"))
    places = [F.lit(0).cast("long"), F.floor(F.col("_all") / 2), F.col("_all") - 1]
    here = F.array_compact(F.array(*(F.when((p >= F.col("_before")) & (p < F.col("_upto")), p) for p in places)))
    sizes = sizes.select("_p", "_b", "_before", here.alias("_at")).filter(F.size("_at") > 0)
    held = df.join(sizes, F.col(partition).eqNullSafe(F.col("_p")) & (F.col("_band") == F.col("_b")))
    at = held.withColumn("_i", F.row_number().over(Window.partitionBy(partition, "_band").orderBy(key)) - 1 + F.col("_before"))
    return at.filter(F.array_contains("_at", F.col("_i"))).drop("_i", "_at", "_before", "_p", "_b", "_band", "_lead")


def first_rows(df: DataFrame, ordinal: str, n: int) -> DataFrame:
    """The ``n`` rows of lowest ``ordinal``, which is unique; a manifest's limit."""
    return df.orderBy(ordinal).limit(n)


def distinct_in_order(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """One row for each value of ``keys``, with the ordinal of its first appearance."""
    return df.groupBy(*keys).agg(F.min(ordinal).alias(ordinal))


def missing_and_extra(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side): missing where only ``expected`` has them, extra where only ``found`` does; none where both sets are equal."""
    return contracts.orphans(expected, found, keys).withColumn("side", F.when(F.col("side") == "left", "missing").otherwise("extra"))


def partition_summary(df: DataFrame, partition: str, speaker: str, samples: str, rate: int = 16000) -> DataFrame:
    return df.groupBy(partition).agg(F.count("*").alias("pairs"), F.countDistinct(speaker).alias("speakers"), F.round(F.sum(samples) / rate / 3600, 6).alias("hours"))


def leakage(df: DataFrame, partition: str, column: str) -> DataFrame:
    """Values of ``column`` that several partitions hold, with these."""
    held = df.groupBy(column).agg(F.array_join(F.array_sort(F.collect_set(partition)), ",").alias("partitions"), F.countDistinct(partition).alias("n"))
    return held.filter("n > 1").select(column, "partitions")


def incremental(inputs: DataFrame, cached: DataFrame, identity: list[str]) -> tuple[DataFrame, DataFrame]:
    """(cached rows that are still valid, inputs to work on), by all columns of the identity."""
    return cached.join(inputs.select(*identity), identity, "left_semi"), inputs.join(cached.select(*identity), identity, "left_anti")


def compare(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row: pairs, matches (null-safe), keys of one side only, and whether all is well."""
    joined = left.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_l")).join(right.select(*keys, F.col(value).alias("_b"), F.lit(1).alias("_r")), keys, "full_outer")
    same = F.col("_a").eqNullSafe(F.col("_b"))
    one = F.count_if(F.col("_l").isNull() | F.col("_r").isNull())
    return joined.agg(F.count("*").alias("pairs"), F.count_if(same).alias("matches"), one.alias("unpaired"), F.bool_and(same & F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("passed"))

