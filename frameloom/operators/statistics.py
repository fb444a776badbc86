"""Summaries of paired scores: grouping sets, exact percentiles, baseline deltas, correlations, stability, bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import resampling
from .ordering import average_ranks, numbered


def summary(df: DataFrame, value: str, by: list[list[str]], digits: int = 6) -> DataFrame:
    """count, mean, median, p10, p25, p75, p90, p95 and the shares above and not below 0 of ``value``, for each grouping in ``by``
    (columns not grouped by are null, ``level`` is the grouping's place)."""
    names = list(dict.fromkeys(c for g in by for c in g))
    out = df.groupingSets([[F.col(c) for c in g] for g in by], *(F.col(c) for c in names)).agg(
        F.count(value).alias("n"), F.round(F.mean(value), digits).alias("mean"),
        F.percentile(value, F.array(*map(F.lit, (0.1, 0.25, 0.5, 0.75, 0.9, 0.95)))).alias("_p"),
        F.round(F.mean((F.col(value) > 0).cast("int")), digits).alias("positive"), F.round(F.mean((F.col(value) >= 0).cast("int")), digits).alias("nonnegative"),
        F.grouping_id().alias("_g"),
    )
    level = F.lit(None).cast("int")
    for i, g in enumerate(by):
        bits = sum(1 << (len(names) - 1 - k) for k, c in enumerate(names) if c not in g)
        level = F.when(F.col("_g") == bits, i).otherwise(level)
    points = {f"p{p}": F.round(F.col("_p")[i], digits) for i, p in enumerate((10, 25, 50, 75, 90, 95))}
    return out.withColumns({"level": level} | points).drop("_p", "_g")


def baseline_delta(df: DataFrame, key: str, condition: str, value: str, baseline: str) -> DataFrame:
    """``df`` with baseline and delta, the value's difference from the baseline condition's of its key: one window, no self-join."""
    base = F.max(F.when(F.col(condition) == baseline, F.col(value))).over(Window.partitionBy(key))
    return df.withColumn("baseline", base).withColumn("delta", F.col(value) - F.col("baseline"))


def correlations(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """n, pearson and spearman; null for fewer than two rows or a constant side. Ranks are those of distinct values, and pairs of values are counted, so
    no task sorts a group."""
    fit = (F.count("*") >= 2) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    plain = df.groupBy(*by).agg(F.count("*").alias("n"), fit.alias("_fit"), F.corr(x, y).alias("_p"))
    cells = df.groupBy(*by, x, y).agg(F.count("*").alias("_w"))
    ranked = cells.join(average_ranks(df, x, by, "_x"), [*by, x]).join(average_ranks(df, y, by, "_y"), [*by, y]).join(plain.select(*by, F.col("n").alias("_n")), by)
    w, a, b = F.col("_w"), F.col("_x") - (F.col("_n") + 1) / 2, F.col("_y") - (F.col("_n") + 1) / 2
    sums = ranked.groupBy(*by).agg(*(F.sum(w * c).alias(k) for k, c in {"_1": F.lit(1.0), "_a": a, "_b": b, "_aa": a * a, "_bb": b * b, "_ab": a * b}.items()))
    top = F.col("_1") * F.col("_ab") - F.col("_a") * F.col("_b")
    low = F.sqrt((F.col("_1") * F.col("_aa") - F.col("_a") * F.col("_a")) * (F.col("_1") * F.col("_bb") - F.col("_b") * F.col("_b")))
    out = plain.join(sums, by, "left")
    return out.select(*by, "n", F.round(F.when(F.col("_fit"), F.col("_p")), 6).alias("pearson"), F.round(F.when(F.col("_fit"), F.try_divide(top, low)), 6).alias("spearman"))


def directions(df: DataFrame, delta: str, by: list[str]) -> DataFrame:
    """Rows better (below 0), equal and worse."""
    return df.groupBy(*by).agg(F.count_if(F.col(delta) < 0).alias("better"), F.count_if(F.col(delta) == 0).alias("equal"), F.count_if(F.col(delta) > 0).alias("worse"))


def leave_one_out(df: DataFrame, group: str, errors: str, base_errors: str, total: str, by: list[str]) -> DataFrame:
    """The rate's difference without each group, from the groups' sums alone, and whether its sign is that of all."""
    sums = df.groupBy(*by, group).agg(*(F.sum(c).alias(f"_{i}") for i, c in enumerate((errors, base_errors, total))))
    w = Window.partitionBy(*by)
    every = [F.sum(f"_{i}").over(w) for i in range(3)]
    out = sums.withColumns({f"_all{i}": c for i, c in enumerate(every)})
    delta = F.try_divide(F.col("_all0") - F.col("_0") - F.col("_all1") + F.col("_1"), F.col("_all2") - F.col("_2"))
    overall = F.try_divide(F.col("_all0") - F.col("_all1"), F.col("_all2"))
    return out.select(*by, group, F.round(delta, 6).alias("delta_without"), F.round(overall, 6).alias("delta"), (F.signum(delta) == F.signum(overall)).alias("same_direction"))


def most_influential(df: DataFrame, key: str, delta: str, by: list[str]) -> DataFrame:
    """by, key and delta of the row with the largest absolute delta of each group, the first key of equals; null deltas are last. Each delta's first key is
    found before, by hash: the struct that orders rows would have every task sort them."""
    first = df.groupBy(*by, delta).agg(F.min(key).alias(key))
    row, order = F.struct(key, delta), F.struct(F.isnull(delta), -F.abs(delta), F.col(key))
    return first.groupBy(*by).agg(F.min_by(row, order).alias("_top")).select(*by, "_top.*")


def hashed_indices(n: int, draws: int, seed: int, spark: SparkSession) -> DataFrame:
    """(draw, place): place = the first 32 bits of MD5(seed:draw:slot) modulo n, the same in any engine."""
    df = spark.range(draws * n).select(F.floor(F.col("id") / n).alias("draw"), (F.col("id") % n).alias("slot"))
    code = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "draw", "slot")), 1, 8), 16, 10).cast("long")
    return df.select("draw", (code % n).alias("place"))


def paired_bootstrap(pairs: DataFrame, key: str, errors: str, base_errors: str, total: str, draws: int, seed: int = 0, generator: str | None = None) -> DataFrame:
    """lower and upper 2.5 % limits of the rate's difference, resampling the keys together. Without ``generator``, hashed places.

    ``generator``: python, numpy or choice (see ``resampling``). Resamples are joined by place with rows in order of their keys, and summed for each draw; limits are exact percentiles.
    """
    spark = pairs.sparkSession
    n = pairs.count()
    if not n:
        raise ValueError("nothing to resample")
    placed = numbered(pairs.select(key, (F.col(errors) - F.col(base_errors)).alias("d"), F.col(total).alias("t")), key, "place").drop(key)
    if generator:
        rows = resampling.resamples(spark, n, draws, seed, generator)
    else:
        rows = hashed_indices(n, draws, seed, spark).groupBy("draw", "place").agg(F.count("*").alias("times"))
    each = rows.join(placed, "place").groupBy("draw").agg((F.sum(F.col("times") * F.col("d")) / F.sum(F.col("times") * F.col("t"))).alias("delta"))
    return each.agg(F.round(F.percentile("delta", 0.025), 6).alias("lower"), F.round(F.percentile("delta", 0.975), 6).alias("upper"), F.count("*").alias("draws"))


def alignment_report(df: DataFrame, metric_delta: str, error_delta: str, by: list[str]) -> DataFrame:
    """How a metric's gain and the errors' change agree: counts, conflicts (metric up, errors up) and correlations with the errors' reduction."""
    df = df.withColumn("_benefit", -F.col(error_delta))
    up, harmed = F.col(metric_delta) > 0, F.col(error_delta) > 0
    counts = df.groupBy(*by).agg(
        F.count("*").alias("utterances"), F.count_if(F.col(error_delta) < 0).alias("improved"), F.count_if(F.col(error_delta) == 0).alias("equal"), F.count_if(harmed).alias("harmed"),
        F.count_if(up).alias("score_improved"), F.count_if(up & harmed).alias("conflicts"),
        F.round(F.count_if(up & harmed) / F.count("*"), 6).alias("conflict_fraction"),
        F.round(F.try_divide(F.count_if(up & harmed).cast("double"), F.count_if(up)), 6).alias("harmed_among_improved"),
        F.round(F.try_divide(F.count_if(up & harmed).cast("double"), F.count_if(harmed)), 6).alias("improved_among_harmed"),
    )
    return counts.join(correlations(df, metric_delta, "_benefit", by).drop("n"), by)
