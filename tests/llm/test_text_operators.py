import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from frameloom.llm import bpe, kernels, minhash, mixing, pieces, quality, queries, rules, skew, tokenfile, toxicity
from tests.llm.conftest import BASE, texts

SPLIT = re.compile(r"[\x20\x09-\x0d]+")


def plain_words(text):
    return [w for w in SPLIT.split(text or "") if w]


def lowered(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def shingles(text):
    w = plain_words(lowered(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(rows):
    """Brute force over all pairs: doc_id to the smallest one that links reach."""
    sets = {i: shingles(t) for i, t, *_ in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets}


def test_words_equal_plain_ones():
    values = [t for _, t, *_ in texts()]
    for a, b, data, offsets in kernels.text_chunks(pa.array(values), 1000):
        starts, ends, first = kernels.word_spans(data, offsets)
        got = [bytes(data[s:e]).decode() for s, e in zip(starts, ends)]
        assert got == [w for t in values[a:b] for w in plain_words(t)]
        assert np.diff(first).tolist() == [len(plain_words(t)) for t in values[a:b]]


def test_hash_table():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64)
    table = kernels.HashTable(4)
    for i in range(0, 5000, 700):
        part = keys[i : i + 700]
        table.add(part, np.arange(i, i + len(part), dtype=np.int32))
    assert (table.find(keys) == np.arange(5000)).all() and (table.find(keys + np.uint64(1)) == -1).all()


def test_minhash_equals_brute_force(documents, odd_documents, no_documents):
    want = components(texts())
    for df in (documents, odd_documents):
        got = minhash.near_duplicates(df).collect()
        assert len(got) == len(texts())
        for r in got:
            if r.doc_id is None:
                assert r.component_id is None and not r.kept
            else:
                assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == want[r.doc_id])
                assert r.n_shingles == len(shingles(dict((i, t) for i, t, *_ in texts())[r.doc_id]))
    assert minhash.near_duplicates(no_documents).count() == 0


def test_minhash_large_group_of_near_copies(spark):
    words = BASE.split() * 3
    words = [f"{w}{k}" for k, w in enumerate(words)]
    rows = [(0, " ".join(words))]
    for i in range(1, 90):
        copy = list(words)
        for j in range(3):
            copy[(i * 37 + j * 113) % len(copy)] = f"edit{i}x{j}"
        rows.append((i, " ".join(copy)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components(rows)


def components_of_rows(rows):
    """The same where rows of one doc_id differ: all rows are compared, and those of a doc_id belong together."""
    apart = components([(k, t) for k, (_, t) in enumerate(rows)])
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(("row", apart[k]), set()).add(i)
    groups = list(groups.values())
    merged = True
    while merged:
        merged = False
        for a in range(len(groups)):
            for b in range(a + 1, len(groups)):
                if groups[a] & groups[b]:
                    groups[a] |= groups.pop(b)
                    merged = True
                    break
            if merged:
                break
    return {i: min(g) for g in groups for i in g}


def test_minhash_rows_of_one_document_that_differ(spark):
    """Ten documents with two texts each, and a near copy of each text; a copy of one text; a chain through one."""
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(200))
    near = lambda k: text(k).replace(f"t{k}w100", "edited")
    rows = [(i, text(10 * i + j)) for i in range(10) for j in (0, 1)] + [(100 + 10 * i + j, near(10 * i + j)) for i in range(10) for j in (0, 1)]
    rows += [(300, text(51)), (301, text(77)), (301, near(31)), (301, ""), (301, "few words"), rows[0], rows[1]]
    want = components_of_rows(rows)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    assert all(r.component_id == want[r.doc_id] for r in got if r.n_shingles)
    assert sum(r.doc_id != r.component_id for r in got if 100 <= r.doc_id < 200) == 20


def test_minhash_isolated_pair_with_few_equal_coordinates(spark):
    """Similarity 0.853, but only 42 of 64 coordinates are equal."""
    rows = [(k, " ".join([f"s22163w{i}" for i in range(178)] + [f"s22163{e}{i}" for i in range(15)])) for k, e in enumerate("ab")]
    a, b = minhash.shingle_sets(pa.array([t for _, t in rows]))
    assert (minhash.signature(a) == minhash.signature(b)).sum() == 42
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components(rows) == {0: 0, 1: 0}


def test_forest_joins_what_is_near():
    near = {0: [2, 3], 1: [3], 4: []}
    a, b = minhash._forest(np.array([0, 1, 4]), np.array([2, 3, 5]), lambda i: np.isin(np.array([2, 3, 5]), near[i]))
    assert sorted(zip(a, b)) == [(0, 2), (0, 3), (1, 3)]


def test_rules_by_hand(documents, no_documents, odd_documents):
    got = {r.doc_id: r for r in rules.judge(rules.counts(documents)).collect() if r.doc_id is not None}
    for i, t, *_ in texts():
        if i is None:
            continue
        w = plain_words(t)
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        seen = {x for x in windows if windows.count(x) > 1} if len(w) < 1000 else set()
        repeat = {k + j for k, x in enumerate(windows) if x in seen for j in range(5)}
        lines = [x for x in (t or "").split("\n") if plain_words(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)))
        assert r.n_repeat_words == len(repeat) and r.base_failed == (len(w) < 10 or 100 * len(repeat) > 20 * len(w))
        assert not (r.kept and r.base_failed) and r.kept == (not r.base_failed and not r.failed)
    assert rules.judge(rules.counts(no_documents)).count() == 0
    assert rules.judge(rules.counts(odd_documents)).count() == len(texts())
    plan = rules.judge(rules.counts(documents))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def targets(sizes, weights, most=3.0):
    """Plain shares of the sum by weight, none above ``most`` times its size, the excess shared anew."""
    total, full = float(sum(sizes)), set()
    while True:
        rest = total - sum(most * sizes[i] for i in full)
        open_ = [i for i in range(len(sizes)) if sizes[i] and i not in full]
        share = {i: rest * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = {i for i in open_ if share[i] > most * sizes[i]}
        if not over:
            return [most * sizes[i] if i in full else share.get(i, 0.0) for i in range(len(sizes))]
        full |= over


def test_targets(spark):
    for sizes in ([10, 10, 10], [1, 100, 3], [0, 0], [7, 0, 1, 900, 2, 5, 5, 400], [3] * 11 + [5000], []):
        rows = [(f"s{i:02d}", i, n) for i, n in enumerate(sizes)]
        sized = spark.createDataFrame(rows, "source string, unit long, size long").withColumns({c: F.lit("x") for c in ("number", "rate", "cells", "extra", "target", "p", "weight")})
        got = {r.source: r for r in mixing.mix(sized).collect()}
        want = targets(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(sizes))])
        assert [got[f"s{i:02d}"].target for i in range(len(sizes))] == pytest.approx(want)
        assert all(r.source_size == r["size"] and r.number == "x" for r in got.values())


def test_order_of_sources(spark):
    names = [None, "", "Z", "a", "é", "\uffff", "😀", "aa"]
    got = mixing.numbered(spark.createDataFrame([(n, 1) for n in names], "source string, n int").repartition(5)).collect()
    want = [*sorted(n for n in names if n is not None), None]
    assert [r.source for r in sorted(got, key=lambda r: r.number)] == want and sorted(r.number for r in got) == list(range(len(names)))


def test_many_sources_are_met_in_parts(spark, documents, monkeypatch):
    key = lambda df: sorted((r.doc_id or -1, r["size"], r.source or "", r.target, r.taken) for r in df.collect())
    want = key(mixing.mix(mixing.sizes(documents)))
    monkeypatch.setattr(skew, "FEW_ROWS", 0)
    assert key(mixing.mix(mixing.sizes(documents))) == want


def test_long_documents_leave_no_gap(spark):
    """Sources with documents of up to 20,000 words among short ones, in several cells: what is taken is within a short document of the target."""
    import random

    rng = random.Random(9)
    rows = [(i, f"s{rng.choice([0, 0, 0, 1, 2, 3])}", rng.choice([20_000, 12_345, 7_001]) if rng.random() < 0.05 else rng.randint(5, 300)) for i in range(6000)]
    rows += [rows[0], rows[0], rows[1]]
    got = mixing.mix(spark.createDataFrame(rows, "unit long, source string, size long")).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w")).collect()
    assert len(got) == 4 and all(abs(r.t - r.w) <= 5 for r in got)


def test_landing():
    p, size = np.array([1.0, 0.4, 0.7, 0.0, 1.0]), np.array([10.0, 20_000, 15_000, 30, 50])
    got = mixing.land(p, size, 15_080.0)
    assert set(got.tolist()) <= {0.0, 1.0} and got @ size == 15_080
    assert mixing.land(np.array([0.5]), np.array([4.0]), 2.0).tolist() in ([0.0], [1.0]) and len(mixing.land(p[:0], size[:0], 0.0)) == 0


def test_flight_keeps_totals():
    draw = np.random.default_rng(0)
    p, size = draw.random(300), draw.integers(1, 1000, 300).astype(float)
    q = mixing.fly(p, size, np.random.default_rng(1))
    assert ((q == 0) | (q == 1)).sum() >= 298
    assert abs(q.sum() - p.sum()) < 1e-6 and abs((q * size).sum() - (p * size).sum()) < 1e-3
    assert (mixing.fly(np.full(50, 0.5), np.ones(50), np.random.default_rng(2)).sum() - 25) < 1e-6


def test_mixing(spark, documents, odd_documents, no_documents):
    got = mixing.mix(mixing.sizes(documents)).collect()
    assert len(got) == len(texts())
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and (r["size"] == 0 or r.taken % r["size"] == 0)
    again = mixing.mix(mixing.sizes(documents.repartition(7))).collect()
    key = lambda rows: sorted((r.doc_id or -1, r["size"], r.taken) for r in rows)
    assert key(got) == key(again)
    assert mixing.mix(mixing.sizes(no_documents)).count() == 0
    assert mixing.mixed(odd_documents).columns == odd_documents.columns
    big = spark.range(6000).select("id", F.concat(F.lit("s"), F.col("id") % 3).alias("source"), (F.col("id") % 50 + 1).alias("size")).withColumnRenamed("id", "unit")
    sums = mixing.mix(big).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w")).collect()
    assert all(abs(r.t - r.w) <= 0.01 * r.w for r in sums)


def test_bpe_equals_tiktoken(spark, documents, odd_documents, no_documents):
    import tiktoken

    path, pattern = bpe.multilingual()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = sorted((i is None, i or 0, own.encode_ordinary(t or "")) for i, t, *_ in texts())
    got = sorted((r.doc_id is None, r.doc_id or 0, r.ids) for r in bpe.encode(documents, path, pattern).collect())
    assert got == want
    for r in bpe.encode(odd_documents, path, pattern, offsets=True).collect():
        text = next(t for i, t, *_ in texts() if i == r.doc_id) or "" if r.doc_id is not None else None
        if text is None:
            continue
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert all(0 <= a < b <= len(text) for a, b in zip(r.starts, r.ends)) and (not r.ids or r.starts[0] == 0 and r.ends[-1] == len(text))
    assert bpe.encode(no_documents, path, pattern).count() == 0


def test_bpe_with_another_pattern(spark):
    """By another pattern all pieces are its own: what it doesn't match goes, and its groups don't matter."""
    import tiktoken

    path, _ = bpe.multilingual()
    rows = [(0, "it's 12ab,cd ef"), (1, ""), (2, None), (3, "日本語 x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ranks = bpe.read_ranks(path)
    for pattern in (r"\S+|\s+", r"(a|b)|[0-9]"):
        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        got = {r.doc_id: r["ids"] for r in bpe.encode(df, path, pattern).collect()}
        assert got == {i: own.encode_ordinary(t or "") for i, t in rows}


def test_encoder_of_a_file_with_other_settings(tmp_path):
    import json

    import tokenizers

    from frameloom.llm import pieces, tokenfile

    settings = json.loads(open(tokenfile.byte_bpe()).read())
    settings["pre_tokenizer"]["add_prefix_space"] = True
    settings["added_tokens"].append(settings["added_tokens"][0] | {"id": 50257, "content": "<x>", "special": False})
    (tmp_path / "own.json").write_text(json.dumps(settings))
    whole = tokenizers.Tokenizer.from_file(str(tmp_path / "own.json"))
    texts = ["one two", "a<x>b", "", "日本"]
    encoder = pieces.library_encoder(str(tmp_path / "own.json"))
    assert not encoder.cuts and pieces.library_encoder(tokenfile.byte_bpe()).cuts
    ids = [i for _, _, x, _ in encoder.encode(pa.array(texts)) for i in x.tolist()]
    assert ids == [i for t in texts for i in whole.encode(t, add_special_tokens=False).ids]


def test_split_characters_come_back_whole():
    own = bpe.codec(*bpe.multilingual())
    text = "日本語 😀 naïve"
    ids = next(iter(own.encoder.encode(pa.array([text]))))[2]
    assert own.decode(ids).tobytes().decode() == text
    assert "".join(own.decode_stream(ids.tolist())) == text
    single = [own.tokens.index(bytes([b])) for b in "é".encode()]
    assert list(own.decode_stream(single)) == ["é"] and list(own.decode_stream(single[:1])) == ["\ufffd"]


def test_cut_equals_pattern_on_random_texts():
    import random

    import public_tokenizers
    import regex

    rng = random.Random(3)
    alphabet = "  \n\t''strevmldLa1é²½ñ٣.,!?$_-\u0085Ω ж\u00a0"
    encoder = pieces.Encoder(lambda p: [len(p)], lambda t: [len(p) for p in regex.findall(public_tokenizers.PATTERN, t)])
    values = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(3000)] + ["日 a b's", ""]
    got = [x.tolist() for _, _, ids, n in encoder.encode(pa.array(values), 500) for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [[len(p) for p in regex.findall(public_tokenizers.PATTERN, v)] for v in values]


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, documents, no_documents, tmp_path, encoding):
    from tokenizers import Tokenizer

    out = f"file://{tmp_path}/tokens"
    tokenfile.write(documents, out, tokenfile.byte_bpe(), encoding)
    whole = Tokenizer.from_file(tokenfile.byte_bpe())
    order = sorted(((i, t) for i, t, *_ in texts()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    ids = [whole.encode(t or "", add_special_tokens=False).ids + [2] for _, t in order]
    starts = np.cumsum([0, *map(len, ids)])
    want = sorted((int(a), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for a, x in zip(starts, ids))
    assert sorted((r.start, r.n_tokens, r.ids_crc32) for r in tokenfile.checksums(spark, out).collect()) == want
    plan = tokenfile.read(spark, out, ["n_tokens"])._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1]
    assert tokenfile.read(spark, out).filter("doc_id = 10").first().ids == ids[[i for i, _ in order].index(10)]
    tokenfile.write(no_documents, f"{out}-none", tokenfile.byte_bpe())
    assert tokenfile.checksums(spark, f"{out}-none").count() == 0


def test_quality(labelled, documents, odd_documents, no_documents):
    docs, labels = labelled
    got = quality.judge(quality.score(docs, labels), labels).join(labels, "doc_id").collect()
    assert sum(r.kept for r in got if r.quality) >= 0.98 * sum(r.quality for r in got)
    assert not any(r.kept for r in got if not r.quality)
    for df in (documents, odd_documents):
        kept = quality.keep_good(df, labels)
        assert kept.columns == df.columns and kept.filter("text is null or text = ''").isEmpty()
    assert quality.keep_good(no_documents, labels).count() == 0
    assert quality.keep_good(documents, labels.limit(0)).count() == len([t for _, t, *_ in texts() if t])


def test_kneser_ney_probabilities_sum_to_one(labelled):
    docs, _ = labelled
    scorer = quality.Scorer(quality.train(docs))
    for context in (b"rive", b"\0\0\0\0", b"zzzz", b" sto"):
        head = 0
        for byte in context:
            head = head << 8 | byte
        codes = np.array([head << 8 | b for b in range(256)], np.uint64)
        assert abs(np.exp(scorer.log_probabilities(codes)).sum() - 1) < 1e-3


def slow_kneser_ney(texts, order):
    """log p of each byte of a text by interpolated modified Kneser-Ney, straight from its definition."""
    from collections import Counter

    grams = {order: Counter()}
    for t in texts:
        raw = bytes(order - 1) + t.encode()
        grams[order].update(raw[i : i + order] for i in range(len(raw) - order + 1))
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    cut = {}
    for k, c in grams.items():
        n = Counter(c.values())
        if all(n[i] for i in (1, 2, 3, 4)):
            y = n[1] / (n[1] + 2 * n[2])
            cut[k] = [0.0] + [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i - 0.05) for i in (1, 2, 3)]
        else:
            cut[k] = [0.0, 0.5, 0.75, 0.9]
    by = {k: {} for k in grams}
    for k, c in grams.items():
        for g, n in c.items():
            by[k].setdefault(g[:-1], []).append(n)

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / 256
        rows = by[k].get(gram[:-1])
        if not rows:
            return p(gram[1:])
        n, total = grams[k][gram], sum(rows)
        return max(n - cut[k][min(n, 3)], 0) / total + sum(cut[k][min(x, 3)] for x in rows) / total * p(gram[1:])

    def perplexity(t):
        raw = bytes(order - 1) + t.encode()
        logs = [np.log(p(raw[i : i + order])) for i in range(len(raw) - order + 1)]
        return float(np.exp(-np.mean(logs)))

    return perplexity


def test_perplexities_equal_slow_kneser_ney(spark, labelled, tmp_path):
    """The registered query on a small table: perplexities of trained and unseen texts, and verdicts by thresholds."""
    docs, labels = labelled
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    more = spark.createDataFrame([(1000, "river stone \u00e9 \u65e5\u672c", None, "s", 1), (1001, "", "en", "s", 0), (1002, None, "en", "s", 0), (1003, "x", "fr", "s", 1), (None, "the river", "en", "s", 1)], docs.schema)
    docs.unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
    trained = docs.join(quality.good_rows(labels).filter(~quality.apart()), "doc_id").collect()
    assert 0.7 < len(trained) / labels.filter("quality = 1").count() < 0.9
    slow = slow_kneser_ney([r.text for r in trained], quality.ORDER)
    got = queries.QUERIES["op7_quality_classifier"](spark, str(tmp_path)).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == 405
    for r in [*docs.limit(40).collect(), *more.collect()]:
        have = by_id[r.doc_id]
        assert have.perplexity is None and not have.kept if not r.text else have.perplexity == pytest.approx(slow(r.text), rel=1e-3)
    assert all(r.kept == (r.perplexity is not None and r.perplexity <= r.threshold) for r in got)


def test_thresholds_of_many_languages(spark, monkeypatch):
    """1,200 languages and none, sizes of all classes: each threshold is the quantile of its own rows that were kept apart, or of the next wider group."""
    import math as m
    import random

    rng = random.Random(2)
    rows = [(i, None if i % 1201 == 1200 else f"l{i % 1201}", rng.choice([50, 50, 300, 1000, 9000]), round(rng.uniform(2, 9), 4)) for i in range(24_020)]
    scored = spark.createDataFrame(rows, "doc_id long, lang string, n_bytes long, perplexity double")
    labels = scored.select("doc_id", (F.col("doc_id") % 3 > 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    chosen = {r.doc_id for r in quality.good_rows(labels).filter(quality.apart()).collect()}
    kind = lambda n: sum(n >= x for x in quality.SIZES)
    groups = {}
    for i, lang, n, p in rows:
        if i in chosen:
            for key in ((0, lang, kind(n)), (2, kind(n)), (1, lang), (3,)):
                groups.setdefault(key, []).append(p)
    monkeypatch.setattr(quality, "LEAST", 1)
    for few in (10_000, 0):
        monkeypatch.setattr(skew, "FEW_ROWS", few)
        got = quality.judge(scored, labels).collect()
        assert len(got) == len(rows)
        for r in got:
            key = next(k for k in ((0, r.lang, kind(r.n_bytes)), (2, kind(r.n_bytes)), (1, r.lang), (3,)) if k in groups)
            assert r.threshold == sorted(groups[key])[m.ceil(quality.QUANTILE * len(groups[key])) - 1]
        assert len({r.lang for r in got if (0, r.lang, kind(r.n_bytes)) in groups}) > 1000


def test_quality_learns_from_all_trusted_rows(spark):
    """More rows than one sample would hold, and a long text: each has been trained on, so its own n-grams are expected."""
    draw = lambda x: F.base64(F.unhex(F.sha2(x.cast("string"), 256)))
    ids = spark.range(6300).withColumnRenamed("id", "doc_id").filter(~quality.apart())
    many = ids.select("doc_id", F.when(F.col("doc_id") > 0, draw(F.col("doc_id"))).alias("text"))
    one = many.agg(F.max("doc_id")).first()[0]
    long = F.concat_ws("", F.transform(F.sequence(F.lit(10_000), F.lit(17_000)), draw))
    docs = many.withColumn("text", F.when(F.col("doc_id") == one, long).otherwise(F.col("text"))).withColumn("lang", F.lit("en")).filter("text is not null")
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    got = quality.score(docs, labels).agg(F.count("*").alias("n"), F.max("perplexity").alias("most"), F.max("n_bytes").alias("bytes")).first()
    assert got.n > 4800 and got.bytes > 1 << 18
    assert got.most < 20


def test_toxicity(labelled, documents, odd_documents, no_documents):
    docs, labels = labelled
    model = toxicity.train(docs, labels.filter(~toxicity.held_out()))
    got = toxicity.tag(docs, model).join(labels, "doc_id").join(docs.select("doc_id", "text"), "doc_id").collect()
    assert np.mean([(r.score >= 0.5) == bool(r.toxic) for r in got]) > 0.97
    for r in got:
        assert 0 <= r.score <= 1
        assert all(r.text[s.start : s.end] in ("idiot", "moron", "scumbag") or " " in r.text[s.start : s.end] for s in r.spans) or not r.toxic
    scored = toxicity.tag(odd_documents, model).collect()
    assert len(scored) == len(texts()) and max(r.score for r in scored if r.doc_id in (0, 1, 2)) < 0.1
    assert next(r for r in scored if r.doc_id == 13).score > 0.5
    assert toxicity.clean(odd_documents, model).columns == odd_documents.columns
    assert toxicity.tag(no_documents, model).count() == 0
    empty = toxicity.train(docs, labels.filter("toxic = 0"))
    assert {r.score for r in toxicity.tag(documents, empty).collect()} == {0.0}


def test_spans_of_a_long_toxic_text_take_linear_time(labelled):
    import time

    docs, labels = labelled
    tagger = toxicity.Tagger(toxicity.train(docs, labels))
    part = "ä idiot you moron, river "
    taken = []
    for n in (100, 10_000, 40_000):
        begun = time.time()
        score, spans = tagger.tag(pa.array([part * n]))
        taken.append(time.time() - begun)
        assert score[0] > 0.5 and len(spans[0]) >= n
        assert {(part * n)[s["start"] : s["end"]] for s in spans[0]} <= {"idiot", "moron,", "idiot you moron,", "you moron,"}
    assert taken[2] < 8 * taken[1]


def test_runs_equal_the_full_chain():
    rng = np.random.default_rng(6)
    model = {"lexicon": np.array([1], np.uint64), "weights": np.array([1.0]), "bias": -2.0, "trans": np.array([[0.4, -1.0], [-0.5, 0.8]]), "curve": None}
    tagger = toxicity.Tagger(model)
    sizes = np.array([1, 5, 40, 3])
    doc = np.repeat(np.arange(4), sizes)
    place = np.concatenate([np.arange(n) for n in sizes])
    held = rng.random(len(doc)) < 0.4
    held[0] = True
    weight = rng.normal(size=len(doc)) * 2
    got = tagger.marginals(doc[held], place[held], weight[held], sizes)
    e = np.where(held, weight, 0.0) - 2.0
    want = []
    for d, n in enumerate(sizes):
        p, _ = toxicity._posteriors(e[doc == d][None], np.ones((1, n), bool), model["trans"])
        want += p[0][held[doc == d]].tolist()
    assert np.allclose(got, want, atol=1e-6)
