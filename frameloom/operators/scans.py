"""Recurrences and trailing windows along streams of any length, on many tasks.

A stream is cut into blocks of BLOCK rows. What a block of a first-order recurrence does to the state that comes in is a map of one number, and such maps compose:

* an average with coefficient a (constant, or a column) maps s to a * s + (1 - a) * x: all of a block together s to A * s + B;
* one that rises and falls at two rates is piecewise linear, continuous and increasing, with one more bend at each value; bends beyond the states that the stream can have are
  left out, and as every step contracts, a block soon maps all of them to one number.

So each block gives its map (first pass over the rows), the maps are followed along each stream (one row for each block, whose state comes in), and each block is run from its state
(second pass). Rows of a block are in one task. Trailing windows need no state: a row is sent to those later blocks whose windows reach back to it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

BLOCK = 1 << 16


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _in_order(t: pa.Table) -> pa.Table:
    return t.take(np.argsort(t.column("n").to_numpy(), kind="stable"))


class Average:
    """s = a * s + (1 - a) * x, from the stream's first value. ``a`` is that of each row."""

    columns = ("value", "keep")

    @staticmethod
    def start(first: float) -> float:
        return first

    @staticmethod
    def run(s: float, value: list[float], keep: list[float]) -> list[float]:
        out = []
        for x, a in zip(value, keep):
            s = a * s + (1 - a) * x
            out.append(s)
        return out

    @classmethod
    def summary(cls, value: list[float], keep: list[float], lo: float, hi: float) -> list[float]:
        return [float(np.prod(keep)), cls.run(0.0, value, keep)[-1]]

    @staticmethod
    def follow(held: list[float], s: float) -> float:
        return held[0] * s + held[1]


class TwoRates:
    """s = a * s + (1 - a) * x, from ``first``, where a is ``rising`` for x above s, and ``falling`` otherwise."""

    columns = ("value",)

    def __init__(self, rising: float, falling: float, first: float):
        self.rising, self.falling, self.first = rising, falling, first

    def start(self, first: float) -> float:
        return self.first

    def run(self, s: float, value: list[float]) -> list[float]:
        out = []
        rising, falling = self.rising, self.falling
        for x in value:
            a = rising if x > s else falling
            s = a * s + (1 - a) * x
            out.append(s)
        return out

    def summary(self, value: list[float], lo: float, hi: float) -> list[float]:
        """Bends and their images, one after the other; a constant is one bend."""
        lo, hi = min(lo, self.first), max(hi, self.first)
        bends, images = np.array([lo, hi]), np.array([lo, hi])
        for i, x in enumerate(value):
            if images[0] == images[-1]:
                return [lo, self.run(float(images[0]), value[i:])[-1]]
            if images[0] < x < images[-1]:
                k = int(np.searchsorted(images, x))
                if images[k] != x:
                    share = (x - images[k - 1]) / (images[k] - images[k - 1])
                    bends = np.insert(bends, k, bends[k - 1] + share * (bends[k] - bends[k - 1]))
                    images = np.insert(images, k, x)
            a = np.where(images < x, self.rising, self.falling)
            images = a * images + (1 - a) * x
        return [*bends.tolist(), *images.tolist()]

    @staticmethod
    def follow(held: list[float], s: float) -> float:
        n = len(held) // 2
        return float(np.interp(s, held[:n], held[n:]))


def scan(df: DataFrame, step, name: str) -> DataFrame:
    """(stream, n, ``name``) of ``df(stream, n, ...)`` with the columns of ``step``, numbers that aren't null; n is unique in its stream. A block's map and state are met at its key, so the rows move
    once for each pass."""
    kind, place = _kind(df, "stream"), _kind(df, "n")
    rows = df.select("stream", "n", F.floor(F.col("n") / BLOCK).alias("_block"), *(F.col(c).cast("double").alias(c) for c in step.columns))
    ends = rows.groupBy("stream").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.collect_set("_block").alias("_blocks"))
    keyed = rows.join(ends.select("stream", "lo", "hi", F.explode("_blocks").alias("_block")), ["stream", "_block"])

    def summarized(t: pa.Table) -> pa.Table:
        t = _in_order(t)
        columns = [t.column(c).to_pylist() for c in step.columns]
        held = step.summary(*columns, t.column("lo")[0].as_py(), t.column("hi")[0].as_py())
        return t.slice(0, 1).select(["stream", "_block"]).append_column("held", pa.array([held], pa.list_(pa.float64()))).append_column("first", t.column("value").slice(0, 1))

    maps = keyed.groupBy("stream", "_block").applyInArrow(summarized, f"stream {kind}, _block long, held array<double>, first double")

    def followed(t: pa.Table) -> pa.Table:
        t = t.take(np.argsort(t.column("_block").to_numpy()))
        s = step.start(t.column("first")[0].as_py())
        states = []
        for held in t.column("held").to_pylist():
            states.append(s)
            s = step.follow(held, s)
        return t.select(["stream", "_block"]).append_column("state", pa.array(states, pa.float64()))

    states = maps.groupBy("stream").applyInArrow(followed, f"stream {kind}, _block long, state double")

    def run(t: pa.Table) -> pa.Table:
        t = _in_order(t)
        found = step.run(t.column("state")[0].as_py(), *(t.column(c).to_pylist() for c in step.columns))
        return t.select(["stream", "n"]).append_column(name, pa.array(found, pa.float64()))

    return rows.join(states, ["stream", "_block"]).groupBy("stream", "_block").applyInArrow(run, f"stream {kind}, n {place}, {name} double")


def trailing(df: DataFrame, value: str, size: int, aggregate: Callable) -> DataFrame:
    """``df`` with trailing: ``aggregate`` of ``value`` over the last ``size`` rows of the stream, n being without gaps."""
    blocks = F.sequence(F.floor(F.col("n") / BLOCK), F.floor((F.col("n") + size - 1) / BLOCK))
    sent = df.withColumn("_block", F.explode(blocks))
    w = Window.partitionBy("stream", "_block").orderBy("n").rowsBetween(1 - size, 0)
    return sent.withColumn("trailing", aggregate(value).over(w)).filter(F.floor(F.col("n") / BLOCK) == F.col("_block")).drop("_block")
