"""Queries on the smallest tables: those with SQL against DuckDB, others against plain Python."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.functions import kernels, text
from frameloom.functions.settings import Placement
from frameloom.operators import contracts, ordering
from frameloom.plans import derived, file_queries, kernel_queries, queries
from frameloom.streaming import chunks

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NEW = [n for n in queries.ORACLE_SQL if getattr(queries.QUERIES[n], "__module__", "") in (file_queries.__name__, kernel_queries.__name__)]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", [*NEW, "corpus_wer_by_condition", "word_distance", "english_normalized", "normalized_wer", "rank_correlation", "most_influential", "paired_bootstrap_ci", "noise_floor_ema", "asymmetric_floor", "run_counters", "frozen_experiment"])
def test_query_agrees_with_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    found = duck.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(plain(v) for v in row) for row in found.fetchall())
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == want


def test_alignment_counts_equal_plain(spark):
    texts = {(r.id, r.condition): r for r in derived.transcripts(spark, SF).collect()}
    got = queries.QUERIES["alignment_counts"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r.id, r.condition]
        counts = text.align_words(t.reference.split(), t.hypothesis.split())
        assert (r.substitutions, r.deletions, r.insertions) == counts and r.errors == sum(counts) and r.words == len(t.reference.split())


def test_long_alignment_is_that_of_short_ones():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = (rng.integers(0, 4, rng.integers(0, 40)) for _ in range(2))
        assert text.align_codes(a, b) == text.align_words(a.tolist(), b.tolist())
    a = rng.integers(0, 500, 1000)
    b = np.delete(np.where(rng.random(1000) < 0.1, 999, a), slice(100, 130))
    s, d, n = text.align_codes(a, b)
    assert 60 < s < 140 and d - n == 30


def test_balanced_sample_equals_plain(spark):
    rows = derived.manifest(spark, SF).collect()
    want = set()
    for speaker in {r.speaker for r in rows}:
        keys = sorted(r.id for r in rows if r.speaker == speaker)
        random.Random(f"20260724:{speaker}").shuffle(keys)
        want |= set(keys[:5])
    got = queries.QUERIES["balanced_sample"](spark, SF).collect()
    assert {r.id for r in got} == want and len(got) == len(want)


def test_speaker_split_equals_plain(spark):
    names = sorted({r.speaker for r in derived.manifest(spark, SF).collect()})
    random.Random(20260724).shuffle(names)
    chosen = set(names[: min(max(round(0.8 * len(names)), 1), len(names) - 1)])
    for r in queries.QUERIES["speaker_split"](spark, SF).collect():
        assert (r.split == "development") == (r.speaker in chosen)


def test_generators_equal_plain(spark):
    scored = {}
    for r in queries.QUERIES["alignment_counts"](spark, SF).collect():
        scored[r.id, r.condition] = (r.errors, r.words)
    ids = sorted(i for i, c in scored if c == "neural")
    d = np.array([scored[i, "neural"][0] - scored[i, "noisy"][0] for i in ids])
    t = np.array([scored[i, "neural"][1] for i in ids])
    n = len(ids)
    r, g = random.Random(17), np.random.default_rng(17)
    places = {"python": [[r.randrange(n) for _ in range(n)] for _ in range(200)], "numpy": np.random.default_rng(17).integers(0, n, (200, n)), "choice": [g.choice(np.arange(n), n) for _ in range(200)]}
    for row in queries.QUERIES["bootstrap_generators"](spark, SF).collect():
        each = [d[p].sum() / t[p].sum() for p in map(np.asarray, places[row.generator])]
        assert (row.lower, row.upper, row.draws) == (pytest.approx(np.percentile(each, 2.5), abs=2e-6), pytest.approx(np.percentile(each, 97.5), abs=2e-6), 200)


def test_mixtures_differ_by_stream_and_keep_their_intervals(spark):
    c = Placement(rate=100, seconds=4.0, shortest=0.2, longest=0.6, least_gap=0.1, most_gap=0.5)
    rows = kernel_queries.labelled_mixtures(spark, SF).collect()
    sides = {r.stream: r for r in derived.pairs(spark, SF).collect()}
    assert len({tuple(r.starts) for r in rows}) > len(rows) // 2
    for r in rows[:50]:
        assert len(r.noisy) == 400 and all(20 <= b - a <= 60 for a, b in zip(r.starts, r.stops)) and all(b + 10 <= a for b, a in zip(r.stops, r.starts[1:]))
        x = np.array(sides[r.stream].reference)
        again = kernels.labelled_mixture([x], [np.array(sides[r.stream].estimate) - x], 5.0, c, np.random.default_rng([20260724, r.stream]))
        assert np.allclose(again["noisy"], r.noisy)
        quiet = np.ones(400, bool)
        for a, b in zip(r.starts, r.stops):
            quiet[a:b] = False
        assert (again["clean"][quiet] == 0).all()


def test_queries_without_sql_equal_their_kernels(spark):
    """The kernels themselves are held against plain loops in test_kernels_slow."""
    streams = {r.stream: np.array(r.samples) for r in kernel_queries.long_streams(spark, SF).collect()}
    got = {}
    for r in kernel_queries.improved_noise_psd(spark, SF).collect():
        got[r.stream, r.frame, r.bin] = (r.noise, r.presence)
    for stream, x in streams.items():
        tracker = kernels.ImprovedMinimaTracker()
        for f, p in enumerate(np.abs(kernels.analyze(x, queries.SHORT)) ** 2):
            noise, presence = tracker.step(p)
            assert all(got[stream, f, b] == (pytest.approx(noise[b]), pytest.approx(presence[b])) for b in range(9))
    short = {r.stream: np.array(r.samples) for r in kernel_queries._arrays(spark, SF).collect()}
    found = {(r.stream, r.n): (r.margin, r.label) for r in kernel_queries.statistical_vad(spark, SF).collect()}
    for stream, x in short.items():
        want = kernels.statistical_activity(x, kernel_queries.STATISTICAL)
        assert [found[stream, n] for n in range(len(want["labels"]))] == [(pytest.approx(m, abs=1e-6), bool(label)) for m, label in zip(want["margin"], want["labels"])]
    found = kernel_queries.intelligibility(spark, SF).collect()
    texts = {r.doc_id: len(r.text or "") for r in derived.table(spark, SF, "documents").collect()}
    assert {r.stream for r in found} == texts.keys()
    assert all(r.stoi == 1e-5 if texts[r.stream] < 4000 else r.stoi < 1 for r in found) and any(0.1 < r.stoi for r in found)


def test_order_in_bands(spark):
    rng = random.Random(8)
    values = rng.sample(range(100_000), 3000)
    df = spark.createDataFrame([(v, "a" if v % 3 else "b", v % 50) for v in values], "k long, g string, v long")
    assert [r.k for r in sorted(ordering.numbered(df, "k", "at").collect(), key=lambda r: r["at"])] == sorted(values)
    got = {(r.g, r.v): r["rank"] for r in ordering.average_ranks(df, "v", ["g"], "rank").collect()}
    for g in "ab":
        held = sorted(v % 50 for v in values if ("a" if v % 3 else "b") == g)
        assert all(got[g, v] == 1 + held.index(v) + (held.count(v) - 1) / 2 for v in set(held))


def test_frozen_protocol():
    protocol = {"model": "small", "decode": {"temperature": 0, "beams": 5}, "on": True}
    have = {"model": "small", "decode": {"temperature": 0.0, "beams": 5, "more": 1}, "on": True, "free": 2}
    assert contracts.frozen(have, protocol) is have
    with pytest.raises(contracts.ContractError, match="decode.beams is 4.*on is 1"):
        contracts.frozen({**have, "decode": {"temperature": 0, "beams": 4}, "on": 1}, protocol)
    with pytest.raises(contracts.ContractError, match="decode must be a group"):
        contracts.frozen({**have, "decode": 3}, protocol)


def test_frozen_experiment_refuses(spark):
    rows = [(i, c, "m", f"s{i}", "cpu") for i in range(3) for c in ("clean", "noisy")]
    df = spark.createDataFrame(rows, "id int, condition string, model string, speaker string, device string")
    check = lambda d, **k: contracts.frozen_experiment(d, "id", "condition", k.get("conditions", {"clean", "noisy"}), ["model"], ["speaker"], {"device": "cpu"})
    assert check(df).count() == 6
    for bad in (df.limit(5), df.union(df.limit(1)), df.withColumn("model", F.col("id").cast("string")), df.withColumn("speaker", F.col("condition")), df.withColumn("device", F.when(F.col("id") > 0, "cpu"))):
        with pytest.raises(contracts.ContractError):
            check(bad)
    with pytest.raises(contracts.ContractError, match="conditions are"):
        check(df, conditions={"clean", "noisy", "neural"})


def test_normalized_english(spark):
    rows = [("He said: “it's DR. Hill's”, (laughs) won't; 1,200.50 [noise] um ok.",), ("they've 'quoted' -- it",), (None,), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(text.normalized_english("t")).collect()]
    assert got == ["he said it is doctor hill's will not 1200.50 ok", "they have quoted it", None, ""]


def test_token_counts(spark):
    path = "/opt/tokenizers/byte_bpe_50k.json"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    texts = ["one two", "", None, "日本語 😀"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text.token_count("t", path)).collect()]
    assert got == [None if t is None else len(own.encode(t, add_special_tokens=False).ids) for t in texts]


def test_finished_streams_leave_no_state(spark, tmp_path):
    rows = [(k, i, [float(k), float(i)], i == 2, None) for k in range(20) for i in range(3) if (k, i) != (7, 2)]
    for k in range(3):
        spark.createDataFrame(rows[k::3], chunks.CHUNK).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(chunks.CHUNK).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = chunks.block_model(source, lambda x: x, 4)
    run = out.writeStream.format("memory").queryName("finished").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    assert run.lastProgress["stateOperators"][0]["numRowsTotal"] == 2  # whose turn it is, and what it carries, of stream 7, which goes on
    got = {}
    for r in spark.table("finished").collect():
        got.setdefault(r.stream, []).append((r.seq, r.samples))
    for k in set(range(20)) - {7}:
        assert [x for _, part in sorted(got[k]) for x in part] == [float(v) for i in range(3) for v in (k, i)]


def test_silent_streams_are_flushed(spark, tmp_path):
    import time

    spark.createDataFrame([(2, 0, [4.0, 5.0], False, None)], chunks.CHUNK).coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(chunks.CHUNK).parquet(f"{tmp_path}/in")
    out = chunks.streamed(source, lambda: chunks.Samples(chunks.Blocks(lambda x: x, 4)), chunks.SAMPLES, chunks.Samples.columns, idle=300)
    run = out.writeStream.format("memory").queryName("silent").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 60
        while time.time() < until and not (found := [x for r in spark.table("silent").collect() for x in r.samples]):
            time.sleep(1)
        assert found == [4.0, 5.0]
    finally:
        run.stop()
