"""Resamples that equal those of Python's and NumPy's generators, made by tasks.

Both draw a place below n from words of 32 bits, each of which is taken or refused by itself: Python takes the upper bits of a word if they are below n, NumPy a word times n by Lemire's
rule. So the places are a filter of the words, and any stretch of words can be made alone: PCG64 is advanced to where it begins; the Mersenne Twister can't be, so the driver runs
its words through once, keeps no words, and hands each stretch the state that it begins with (2.5 KB for WORDS words). Tasks first count what each stretch takes; the sums of these counts
are the numbers of its places, and with them tasks make the stretches again.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

WORDS = 1 << 20  # of 32 bits, in one stretch; even
STATE = "block long, state binary"


def _taken(words: np.ndarray, n: int, generator: str) -> np.ndarray:
    """The places of the words that are taken."""
    if generator == "python":
        places = words >> np.uint64(32 - n.bit_length())
        return places[places < n]
    wide = words * np.uint64(n)
    low = wide & np.uint64(0xFFFFFFFF)
    return (wide >> np.uint64(32))[low >= np.uint64((2**32 - n) % n)]


def _words(block: int, state: bytes, seed: int, generator: str) -> np.ndarray:
    """A stretch's words, as numbers of 64 bits."""
    if generator == "python":
        return _twister(np.frombuffer(state, "<u4")).random_raw(WORDS).astype(np.uint64)
    bits = np.random.PCG64(seed)
    bits.advance(block * (WORDS // 2))
    return bits.random_raw(WORDS // 2).astype("<u8").view("<u4").astype(np.uint64)


def _twister(state: np.ndarray) -> np.random.MT19937:
    bits = np.random.MT19937()
    bits.state = {"bit_generator": "MT19937", "state": {"key": state[:624].astype(np.uint32), "pos": int(state[624])}}
    return bits


def _stretches(spark: SparkSession, n: int, blocks: int, seed: int, generator: str) -> DataFrame:
    """Each stretch in a task of its own; only the Twister's have states."""
    if generator != "python":
        return spark.range(0, blocks, 1, blocks).select(F.col("id").alias("block"), F.lit(None).cast("binary").alias("state"))
    bits = _twister(np.array(random.Random(seed).getstate()[1], np.uint64))
    rows = []
    for block in range(blocks):
        held = bits.state["state"]
        rows.append((block, np.append(held["key"], held["pos"]).astype("<u4").tobytes()))
        bits.random_raw(WORDS, output=False)
    return spark.createDataFrame(rows, STATE).repartition(blocks, "block")


def resamples(spark: SparkSession, n: int, draws: int, seed: int, generator: str) -> DataFrame:
    """(draw, place, times) of ``draws`` resamples of n places below 2**32: by ``random.Random(seed).randrange(n)`` ("python"), or ``numpy.random.default_rng(seed)``: its ``integers(0, n, (draws, n))``
    ("numpy"), or ``choice`` of n for each draw ("choice"), which takes the same words. One number for each stretch of WORDS words comes to the driver."""
    if generator not in ("python", "numpy", "choice"):
        raise ValueError("unknown generator")
    if not 0 < n < 2**32 or draws < 0:
        raise ValueError("n must be positive and below 2**32, and draws not negative")
    if n == 1 and generator != "python":
        return spark.range(draws).select(F.col("id").alias("draw"), F.lit(0).cast("long").alias("place"), F.lit(1).cast("long").alias("times"))
    need = n * draws
    share = n / 2 ** n.bit_length() if generator == "python" else 1 - (2**32 % n) / 2**32
    blocks = max(1, -(-int(need / share * 1.001 + 8 * (need / share) ** 0.5) // WORDS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken = [len(_taken(_words(b, s, seed, generator), n, generator)) for b, s in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(taken, pa.int64())], ["block", "taken"])

    while True:
        stretches = _stretches(spark, n, blocks, seed, generator)
        counts = dict(map(tuple, stretches.mapInArrow(count, "block long, taken long").collect()))
        if sum(counts.values()) >= need:
            break
        blocks += 1
    before = np.cumsum([0, *(counts[b] for b in range(blocks))])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, s in zip(*(c.to_pylist() for c in batch.columns)):
                places = _taken(_words(b, s, seed, generator), n, generator)[: max(0, need - int(before[b]))]
                draw = (int(before[b]) + np.arange(len(places))) // n
                cell, times = np.unique(draw * n + places.astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell // n), pa.array(cell % n), pa.array(times)], ["draw", "place", "times"])

    return stretches.mapInArrow(make, "draw long, place long, times long")
