"""Removal of repeated strings against every window in a dictionary, and the query against its SQL."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.llm import repeats

from .test_variants import agrees


def test_query_equals_sql(spark):
    agrees(spark, repeats.op12, repeats.OP12_SQL, ["documents"])


def plain(rows, window=400):
    texts = [(t or "").encode() for _, t in rows]
    seen: dict = {}
    for x in texts:
        for i in range(len(x) - window + 1):
            w = x[i : i + window]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for (doc_id, _), x in zip(rows, texts):
        gone = np.zeros(len(x) + 1, np.int64)
        for i in range(len(x) - window + 1):
            if seen[x[i : i + window]] > 1:
                gone[i] += 1
                gone[i + window] -= 1
        cut = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.concatenate([[False], cut]).astype(int)) == 1).sum())
        out.append((doc_id, len(x), int(cut.sum()), spans, hashlib.sha256(np.frombuffer(x, np.uint8)[~cut].tobytes()).hexdigest()))
    return sorted(out, key=repr)


def prose(rng, n):
    return " ".join(rng.choice(["river", "stone", "wäter", "mountain", "日本", "light", "of", "the", "garden"]) + str(rng.randrange(40)) for _ in range(n))


def corpus():
    rng = random.Random(7)
    passages = [prose(rng, 60), prose(rng, 75), prose(rng, 200)]
    rows = []
    for i in range(40):
        parts = [prose(rng, rng.randrange(0, 90)) for _ in range(3)]
        for p in rng.sample(passages, rng.randrange(3)):
            parts.insert(rng.randrange(4), p)
        rows.append((i, "".join(parts)))
    base = prose(rng, 150)
    near = [(50 + i, base[: 90 * i] + "changed" + base[90 * i + 7 :]) for i in range(12)]
    exact = "".join(rng.choice("abcdef") for _ in range(400))
    edge = [(80, exact), (81, "x" + exact), (82, exact + "y"), (83, exact[1:]), (84, exact[:-1])]
    line = prose(rng, 20) + "\n"
    runs = [(90, "a" * 3000), (91, "a" * 399), (92, "b" * 400), (93, "b" * 401), (94, line * 9), (95, "ab" * 700 + "c" + "ab" * 500)]
    return [*rows, *near, *edge, *runs, (60, None), (61, ""), (None, base), (None, None), rows[0], rows[3], (0, prose(rng, 50)), (3, rows[5][1])]


@pytest.mark.parametrize("kinds, part, piece", [(1 << 11, 1 << 21, 1 << 20), (1, 1 << 21, 700), (1 << 11, 3000, 1100)])
def test_removed_bytes_are_those_of_all_windows(spark, monkeypatch, kinds, part, piece):
    """By sorting, by counting residues, and with small tasks and long texts in pieces."""
    monkeypatch.setattr(repeats, "KINDS", kinds)
    monkeypatch.setattr(repeats, "PART", part)
    monkeypatch.setattr(repeats, "PIECE", piece)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in repeats.without_repeats(df).collect()), key=repr)
    want = plain(rows)
    assert 0 < sum(r[2] for r in want) < sum(r[1] for r in want)
    assert got == want


def test_refinement_finds_equal_strings():
    rng = np.random.default_rng(5)
    for depth in (8, 9, 16, 39, 400):
        parts = [rng.integers(0, 2, rng.integers(0, 3 * depth)).astype(np.uint8) for _ in range(12)]
        parts += [parts[0], np.concatenate([parts[1], parts[2]]), np.zeros(2 * depth, np.uint8)]
        data, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        stop = np.repeat(ends, [len(p) for p in parts])
        got = repeats.refined(data, stop, depth)
        windows = [data[i : i + depth].tobytes() if i + depth <= stop[i] else None for i in range(len(data))]
        assert got.tolist() == [w is not None and windows.count(w) > 1 for w in windows]


def test_empty_odd_and_long_tables(spark, no_documents, odd_documents, documents):
    assert repeats.without_repeats(no_documents).collect() == []
    odd = odd_documents.withColumns({c: F.lit(1) for c in ("d1", "d2", "spans", "own")})
    same = [sorted(map(tuple, repeats.without_repeats(d).collect()), key=repr) for d in (documents, odd)]
    assert same[0] == same[1] and len(same[0]) == documents.count()
    short = [(r.doc_id, r.text) for r in documents.collect() if r.text is None or len(r.text) < 100_000]
    assert [r for r in same[0] if r[1] < 100_000] == plain(short)  # the long text shares nothing with others
