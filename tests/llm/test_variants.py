"""Spelling variants against all pairs of words, and the query against its SQL."""

import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.llm import variants

SF = "/root/testdata/sf0.001"


def agrees(spark, query, sql, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    got = query(spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, found.fetchall()))


def test_query_equals_sql(spark):
    agrees(spark, variants.op11, variants.OP11_SQL, ["documents"])


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts):
    out = {}
    for w, n in counts.items():
        others = [x for x in counts if near(w, x)]
        top = min(others, key=lambda x: (-counts[x], x), default=None)
        formed = top is not None and counts[top] >= 5 * n
        out[w] = (top if formed else None, n, len(others), counts[top] if formed else None)
    return out


def root(found, w):
    while found[w][0] is not None:
        w = found[w][0]
    return w


def lexicon(rng, n=120):
    out = {}
    for _ in range(n):
        w = "".join(rng.choice("abàÿ") for _ in range(rng.randint(6, 8)))
        out[w] = rng.choice([5, 6, 30, 31, 200, 5000])
        for _ in range(3):
            i, kind = rng.randrange(len(w)), rng.randrange(3)
            v = w[:i] + ("" if kind == 0 else rng.choice("abé")) + w[i + (kind != 2) :]
            if len(v) >= 6:
                out[v] = rng.choice([5, 6, 30, 150])
    return out


@pytest.mark.parametrize("part", [1 << 20, 40])
def test_near_words_are_all_pairs(spark, monkeypatch, part):
    """Whole, and with every key cut into blocks."""
    monkeypatch.setattr(variants, "PART", part)
    counts = lexicon(random.Random(part)) | {"aaaaaa": 7, "aaaaaaa": 8, "aaaaaaaa": 9}
    got = variants.near_words(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    want = {(a, b, counts[b]) for a in counts for b in counts if near(a, b)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_wavelet_tree_reports_rectangles():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 64, 100):
        values = rng.permutation(n)
        left, low = rng.integers(0, n + 1, 50), rng.integers(0, n + 1, 50)
        right, high = rng.integers(left, n + 1), rng.integers(low, n + 1)
        one, value = variants.WaveletTree(values).report(left, right, low, high)
        want = sorted((i, v) for i in range(50) for v in values[left[i] : right[i]].tolist() if low[i] <= v < high[i])
        assert sorted(zip(one.tolist(), value.tolist())) == want


def counted(rows):
    counts = {}
    for doc_id, text in rows:
        run = ""
        for ch in [*(text or ""), " "]:
            if ch.isascii() and ch.isalpha() or "À" <= ch <= "ÿ":
                run += ch.lower() if ch.isascii() else ch
                continue
            if run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                w = run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]
                if len(w) >= 6:
                    counts[w] = counts.get(w, 0) + 1
                run = ""
    return {w: n for w, n in counts.items() if n >= 5}


def corpus():
    rng = random.Random(12)
    words = [*lexicon(rng, 12), "ÀÉÎõü÷×x", "water1x", "Été"]
    rows = [(i, " ".join(rng.choice([w, w.upper(), w.title()]) + rng.choice([" ", ",", "9", "日", "ß "]) for w in rng.choices(words, k=200))) for i in range(60)]
    rows += [(100 + i, "straßenbau" + "verylongword" * 900) for i in range(6)] + [(106, "straßenbau" + "verylongword" * 450 + "x" + "verylongword" * 450)] * 5
    return [*rows, (None, "bababa " * 9), (7, None), (8, ""), (9, "x"), rows[0], rows[0]]


def test_variants_of_texts_equal_plain(spark):
    rows = corpus()
    want = plain(counted(rows))
    assert any(f for f, *_ in want.values()) and any(len(w) > 10_000 for w in want)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.word: r for r in variants.variants(df).collect()}
    assert got.keys() == want.keys()
    for w, (form, n, n_near, form_n) in want.items():
        assert (got[w].form, got[w].n, got[w].n_near, got[w].form_n, got[w].root) == (form, n, n_near, form_n, root(want, w))


def test_chains_end_at_their_last_form(spark):
    forms = [(f"w{i:02}", f"w{i + 1:02}") for i in range(17)] + [("x", "w16"), ("y", "z")]
    got = {r.word: r.root for r in variants.roots(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert got == {**{f"w{i:02}": "w17" for i in range(17)}, "x": "w17", "y": "z"}


def test_empty_and_odd_tables(spark, no_documents, odd_documents, documents):
    assert variants.variants(no_documents).collect() == []
    more = F.concat("text", F.lit(" Spelled SPELLED spelled spellet"))
    odd = odd_documents.withColumns({"text": more, "word": F.lit(1), "n": F.lit("x")})
    same = [sorted(map(tuple, variants.variants(d).collect()), key=repr) for d in (documents.withColumn("text", more), odd)]
    assert same[0] == same[1] and {r[0] for r in same[0]} >= {"spelled", "spellet"}
