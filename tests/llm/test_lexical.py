"""Ranked search against all scores, and the query against its SQL."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.llm import lexical

from .test_variants import agrees


def test_query_equals_sql(spark):
    agrees(spark, lexical.op13, lexical.OP13_SQL, ["documents", "benchmark"])


def terms(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plain(documents, queries, k=10):
    bags = [(d, terms(t)) for d, t in documents]
    bags = [(d, b) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(len(b) for _, b in bags)
    df: dict = {}
    for _, b in bags:
        for t in set(b):
            df[t] = df.get(t, 0) + 1
    out = []
    for q, text in queries:
        scores = []
        for d, b in bags:
            m = 10 + 90 * len(b) * n_docs // n_terms
            score = 0
            for t in set(terms(text)):
                if tf := b.count(t):
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (10**9 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(q, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(21)
    words = [f"word{i}" for i in range(60)] + ["Ünïcode", "日本語", "a1b2", "THE", "the", "of"]
    weights = [1 / (i + 1) for i in range(len(words))]
    documents = [(i, rng.choice([" ", "-", "\n"]).join(rng.choices(words, weights, k=rng.randrange(1, 60)))) for i in range(150)]
    documents += [(200, None), (201, ""), (202, "--- ..."), (None, "word1 word2 word3"), (None, "word1 word2 word3"), documents[5], documents[5], (5, "word7"), (300, "word50 " * 3000)]
    queries = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(1, 25)))) for i in range(30)]
    queries += [(40, None), (41, ""), (42, "nowhere at all"), (43, "word59"), (44, "word1 WORD1 Word1"), (None, "word2"), (3, "word4"), queries[7]]
    return documents, queries


@pytest.mark.parametrize("pairs, k", [(1 << 18, 10), (40, 10), (1 << 18, 3)])
def test_ranking_equals_all_scores(spark, monkeypatch, pairs, k):
    """In one block of queries, and in many."""
    monkeypatch.setattr(lexical, "PAIRS", pairs)
    monkeypatch.setattr(lexical, "LIST", 16)
    documents, queries = corpus()
    docs, asked = spark.createDataFrame(documents, "doc_id long, text string").repartition(3), spark.createDataFrame(queries, "query_id long, text string").repartition(2)
    got = sorted((tuple(r) for r in lexical.search(docs, asked, k).collect()), key=repr)
    assert got == plain(documents, queries, k)


def test_empty_and_odd_tables(spark, no_documents, odd_documents, documents):
    asked = spark.createDataFrame([(1, "alpha1 beta3"), (2, "idiot")], "query_id long, text string")
    assert lexical.search(no_documents, asked).collect() == lexical.search(documents, asked.limit(0)).collect() == []
    odd = odd_documents.withColumns({c: F.lit(1) for c in ("row", "n", "tid", "query", "rank")})
    found = [sorted(map(tuple, lexical.search(d, a).collect())) for d, a in ((documents, asked), (odd, asked.withColumn("n", F.lit("x"))))]
    assert found[0] == found[1] and {r[0] for r in found[0]} == {1, 2}


def test_terms_of_bytes():
    import pyarrow as pa
    from frameloom.llm.kernels import text_chunks

    for text in ["", "a", "É-x9_Z", "日本 x\u0000y", "\u0080é"]:
        for _, _, data, offsets in text_chunks(pa.array([text])):
            starts, ends, document = lexical.term_spans(data, offsets)
            assert [data[a:b].tobytes().decode() for a, b in zip(starts, ends)] == re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)
            assert np.all(document == 0)
