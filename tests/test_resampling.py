"""Resamples of tasks against the generators themselves, over several stretches of words."""

import random

import numpy as np
import pytest

from frameloom.operators import resampling


def plain(n, draws, seed, generator):
    if generator == "python":
        r = random.Random(seed)
        return [[r.randrange(n) for _ in range(n)] for _ in range(draws)]
    r = np.random.default_rng(seed)
    return r.integers(0, n, (draws, n)).tolist() if generator == "numpy" else [r.choice(np.arange(n), n).tolist() for _ in range(draws)]


def counted(rows):
    out = {}
    for d, row in enumerate(rows):
        for p in row:
            out[d, p] = out.get((d, p), 0) + 1
    return out


@pytest.mark.parametrize("generator", ["python", "numpy", "choice"])
@pytest.mark.parametrize("n, draws, seed", [(1, 3, 0), (2, 50, 7), (37, 101, 20260724), (640, 9, 0), (5, 0, 1)])
def test_resamples_equal_the_generators(spark, monkeypatch, generator, n, draws, seed):
    monkeypatch.setattr(resampling, "WORDS", 500)
    got = {}
    for r in resampling.resamples(spark, n, draws, seed, generator).collect():
        got[r.draw, r.place] = got.get((r.draw, r.place), 0) + r.times
    assert got == counted(plain(n, draws, seed, generator))


def test_refused_words_are_those_of_the_generator(monkeypatch):
    """Of places below three quarters of 2**32 every fourth word is refused."""
    n = 3 * 2**30
    monkeypatch.setattr(resampling, "WORDS", 1000)
    words = np.concatenate([resampling._words(b, b"", 11, "numpy") for b in range(3)])
    want = np.random.default_rng(11).integers(0, n, 2000)
    assert resampling._taken(words, n, "numpy")[:2000].tolist() == want.tolist()


def test_long_resamples_are_made_by_many_tasks(spark):
    n, draws = 200_003, 12
    df = resampling.resamples(spark, n, draws, 3, "numpy")
    assert df.rdd.getNumPartitions() >= 3
    got = df.groupBy("draw").sum("times").collect()
    assert sorted((r[0], r[1]) for r in got) == [(d, n) for d in range(draws)]
    last = np.random.default_rng(3).integers(0, n, (draws, n))[-1]
    rows = df.filter("draw = 11").toPandas().groupby("place")["times"].sum()
    assert rows.to_dict() == dict(zip(*(x.tolist() for x in np.unique(last, return_counts=True))))


def test_bad_arguments(spark):
    for args in ((0, 1, 1, "numpy"), (2**32, 1, 1, "numpy"), (3, -1, 1, "python"), (3, 1, 1, "other")):
        with pytest.raises(ValueError):
            resampling.resamples(spark, *args)
