"""Block scans against plain loops, with blocks so short that maps don't become constant, and one long stream on many tasks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.operators import scans, signals


def streams(sizes=(1, 7, 49, 50, 51, 333)):
    rng = random.Random(5)
    return {k: [rng.choice([rng.gauss(-50, 9), rng.gauss(0, 30), -50.0]) for _ in range(n)] for k, n in enumerate(sizes)}


def table(spark, values):
    rows = [(k, i, x, 0.5 + 0.5 * ((i * 7 + k) % 11) / 11) for k, v in values.items() for i, x in enumerate(v)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "stream long, n long, value double, keep double").repartition(5)


def averaged(values, keep):
    s, out = values[0], []
    for x, a in zip(values, keep):
        s = a * s + (1 - a) * x
        out.append(s)
    return out


def two_rates(values, rising, falling, s):
    out = []
    for x in values:
        a = rising if x > s else falling
        s = a * s + (1 - a) * x
        out.append(s)
    return out


def close(df, name, want):
    got = {(r.stream, r.n): r[name] for r in df.collect()}
    assert got.keys() == {(k, i) for k, v in want.items() for i in range(len(v))}
    for k, v in want.items():
        assert np.allclose([got[k, i] for i in range(len(v))], v, rtol=1e-12, atol=1e-9)


@pytest.fixture
def short_blocks(monkeypatch):
    monkeypatch.setattr(scans, "BLOCK", 50)


def test_averages(spark, short_blocks):
    values = streams()
    close(signals.ema(table(spark, values), "value", 0.97), "ema", {k: averaged(v, [0.97] * len(v)) for k, v in values.items()})
    keep = {k: [0.5 + 0.5 * ((i * 7 + k) % 11) / 11 for i in range(len(v))] for k, v in values.items()}
    close(signals.ema(table(spark, values), "value", F.col("keep")), "ema", {k: averaged(v, keep[k]) for k, v in values.items()})


@pytest.mark.parametrize("rising, falling, first", [(0.98, 0.8, -55.0), (0.7, 0.999, 400.0), (1.0, 0.5, 0.0), (0.0, 0.9, 3.0)])
def test_two_rates(spark, short_blocks, rising, falling, first):
    values = streams()
    close(signals.asymmetric_ema(table(spark, values), "value", rising, falling, first), "floor", {k: two_rates(v, rising, falling, first) for k, v in values.items()})


def test_a_map_holds_for_every_state_that_comes_in():
    values = streams((120,))[0]
    step = scans.TwoRates(0.98, 0.8, -55.0)
    held = step.summary(values[:20], min(values), max(values))
    for s in [min(values), *values, -50.0, max(values)]:
        assert np.isclose(step.follow(held, s), two_rates(values[:20], 0.98, 0.8, s)[-1], rtol=1e-12, atol=1e-10)
    assert len(step.summary(values * 50, min(values), max(values))) == 2  # constant by then


@pytest.mark.parametrize("size", [1, 10, 50, 170])
def test_trailing_windows_reach_into_blocks_before(spark, short_blocks, size):
    values = streams()
    want = {k: [round(min(v[max(0, i - size + 1) : i + 1]), 6) for i in range(len(v))] for k, v in values.items()}
    close(signals.trailing(table(spark, values), "value", size), "trailing", want)
    want = {k: [float(np.percentile(v[max(0, i - size + 1) : i + 1], 20)) for i in range(len(v))] for k, v in values.items()}
    got = signals.trailing(table(spark, values), "value", size, 0.2)
    assert all(abs(r.trailing - want[r.stream][r.n]) < 1e-6 for r in got.collect())


def test_one_long_stream_runs_on_many_tasks(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit(3).cast("long").alias("stream"), F.col("id").alias("n"), (F.pmod(F.col("id") * 7919, F.lit(1009)) / 7 - 60).alias("value"))
    values = (np.arange(n) * 7919 % 1009 / 7 - 60).tolist()
    for out, want in ((signals.ema(df, "value", 0.999), averaged(values, [0.999] * n)), (signals.asymmetric_ema(df, "value", 0.98, 0.8, -55.0), two_rates(values, 0.98, 0.8, -55.0))):
        found = out.withColumn("task", F.spark_partition_id()).toPandas().sort_values("n")
        assert np.allclose(found[out.columns[-1]], want, rtol=1e-11, atol=1e-9) and len(found) == n
        assert found["task"].nunique() > 1


def test_an_empty_table(spark):
    none = table(spark, streams()).limit(0)
    assert signals.ema(none, "value", 0.9).count() == signals.asymmetric_ema(none, "value", 0.9, 0.8, 0.0).count() == signals.trailing(none, "value", 5).count() == 0
