import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.functions import text
from frameloom.functions.settings import Endpoints, Framing
from frameloom.operators import contracts, sampling, scoring, signals, statistics
from frameloom.sources import files
from frameloom.streaming import chunks


def test_alignment_equals_plain(spark):
    rng = random.Random(5)
    rows = [([rng.choice("abc") for _ in range(rng.randint(1, 8))], [rng.choice("abcd") for _ in range(rng.randint(0, 8))]) for _ in range(60)]
    df = spark.createDataFrame(rows, "r array<string>, h array<string>")
    for row in df.select("r", "h", text.alignment("r", "h").alias("a")).collect():
        assert (row.a.s, row.a.d, row.a.n) == text.align_words(row.r, row.h) and row.a.c == sum(text.align_words(row.r, row.h))


def test_corpus_rate_is_of_sums(spark):
    df = spark.createDataFrame([(1, "noisy", "a b c d", "a b c x"), (2, "noisy", "a", "b")], "id int, condition string, reference string, hypothesis string")
    assert scoring.corpus_rates(scoring.score(df)).first().wer == 0.4
    with pytest.raises(Exception, match="empty reference"):
        scoring.score(spark.createDataFrame([(1, "noisy", " ", "a")], df.schema)).collect()


def test_repeated_ngrams(spark):
    df = spark.createDataFrame([("a b c d a b c d a b c d",), ("a b",), ("",)], "t string").withColumn("w", text.words("t"))
    assert [r[0] for r in df.select(text.repeated_ngram_fraction("w", 4)).collect()] == [1.0, 0.0, 0.0]


def test_contracts_raise(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", None)], "id int, condition string, t double")
    with pytest.raises(contracts.ContractError):
        contracts.unique(df, ["id"])
    with pytest.raises(contracts.ContractError):
        contracts.paired(df, "id", "condition")
    with pytest.raises(contracts.ContractError):
        contracts.single_value(df, ["condition"])
    with pytest.raises(contracts.ContractError):
        contracts.all_or_none(df, ["t"])
    with pytest.raises(contracts.ContractError):
        contracts.constant_within(df, "id", ["condition"])
    with pytest.raises(contracts.ContractError):
        contracts.without(df, {"t"})
    contracts.unique(df, ["id", "condition"])


def test_selective_rate_needs_all_rows(spark):
    df = spark.createDataFrame([("x", 1, 4, 1), ("x", 2, 4, None)], "condition string, errors int, words int, final_errors int")
    row = scoring.selective(df, ["condition"]).first()
    assert row.coverage == 0.5 and row.full_coverage_wer is None and row.selective_wer == 0.25


def test_decision_falls_back_far_from_noisy(spark):
    rows = [("u", "noisy", "the boats came home late", False, []), ("u", "neural", "bad", True, [("six green apples fell", False)])]
    df = spark.createDataFrame(rows, "id string, condition string, hypothesis string, anomalous boolean, retries array<struct<hypothesis:string,anomalous:boolean>>")
    got = {r.condition: (r.final_source, r.final_hypothesis) for r in scoring.decide(df, ["neural"]).collect()}
    assert got == {"noisy": ("first_pass", "the boats came home late"), "neural": ("noisy_fallback", "the boats came home late")}


def test_bootstrap_of_constant_difference(spark):
    df = spark.createDataFrame([(i, 0, 1, 2) for i in range(4)], "id int, e int, b int, w int")
    for generator in (None, "python", "numpy", "choice"):
        row = statistics.paired_bootstrap(df, "id", "e", "b", "w", 101, 17, generator).first()
        assert (row.lower, row.upper) == (-0.5, -0.5)


def test_sampling(spark):
    df = spark.createDataFrame([(f"s{s}_{i}", f"s{s}", "n") for s in range(3) for i in range(5)], "id string, speaker string, noise string")
    assert sampling.by_speaker(df, "speaker", "id", 2, 1).count() == 6
    small, large = ({r.id for r in sampling.by_strata(df, ["speaker"], "id", k, 7).collect()} for k in (1, 3))
    assert small < large
    with pytest.raises(contracts.ContractError):
        sampling.by_strata(df, ["speaker"], "id", 6, 7)
    split = sampling.split_speakers(df, "speaker", 3, fraction=0.5)
    assert sampling.leakage(split, "split", "speaker").isEmpty()


def test_interval_labels(spark):
    frames = spark.createDataFrame([(0, i) for i in range(8)], "stream int, frame long")
    intervals = spark.createDataFrame([(0, 3, 7)], "stream int, start long, stop long")
    got = signals.interval_labels(frames, intervals, Framing(4, 2)).orderBy("frame").collect()
    assert [r.active for r in got] == [True, True, True, True, False, False, False, False]


def test_mixes_and_delay(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [0.0, 0.0, 0.0])], "enhanced array<double>, noisy array<double>")
    row = df.select(signals.residual_mix(0.5).alias("m"), signals.delay_compensated("enhanced", 1).alias("d"), signals.clip_count("enhanced").alias("c")).first()
    assert (row.m, row.d, row.c) == ([0.5, 1.0, 1.5], [2.0, 3.0, 0.0], 2)


def test_audio_round_trip(spark, tmp_path):
    x = np.sin(np.arange(500) / 9).astype(np.float32)
    df = spark.createDataFrame([("a", x.tolist(), 16000), ("b_1", x[:7].tolist(), 8000)], "stem string, samples array<float>, sample_rate int")
    assert files.write_audio(df, f"file://{tmp_path}/wav").count() == 2
    got = {r.stem: r for r in files.read_audio(spark, f"file://{tmp_path}/wav").collect()}
    assert np.array_equal(np.float32(got["a"].samples), x) and got["b_1"].sample_rate == 8000
    paired = files.audio_files(spark, f"file://{tmp_path}/wav")
    assert {r.speaker_id for r in files.pair_files(paired, paired).collect()} == {"a", "b"}
    with pytest.raises(contracts.ContractError):
        files.pair_files(paired, paired.filter("stem = 'a'"))


def test_the_most_influential_row_is_found_by_hash(spark):
    from frameloom.operators import statistics

    rows = [("a", k, None if k == 0 else d) for k, d in enumerate((9, 1, -7, 7, 2, -7))] + [("b", 4, 0), ("b", 3, 0), ("c", 8, None), ("c", 7, None), (None, 5, -1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "g string, id long, delta long, more string")
    top = statistics.most_influential(df, "id", "delta", ["g"])
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.rfind("HashAggregate") > plan.rfind("SortAggregate")  # the deepest, which meets all rows
    assert {tuple(r) for r in top.select("g", "id", "delta").collect()} == {("a", 2, -7), ("b", 3, 0), ("c", 7, None), (None, 5, -1)}


def test_paired_rows_are_dealt_by_their_number(spark, monkeypatch):
    from frameloom.operators import ordering
    from frameloom.plans import queries

    monkeypatch.setattr(ordering, "DEALT", 50)
    df = queries._paired(spark, "/root/testdata/sf0.001")
    n = df.count()
    assert n > 500 and df.rdd.getNumPartitions() == -(-n // 50)
    monkeypatch.setattr(ordering, "DEALT", 1)
    assert queries._paired(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 200  # writers hold no rows
    assert ordering.dealt(spark.range(3), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_influence_removed_takes_two_passes_that_are_dealt(spark, monkeypatch):
    from frameloom.operators import ordering
    from frameloom.plans import queries

    monkeypatch.setattr(ordering, "DEALT", 50)
    plan = queries.most_influential_removed(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in plan[plan.rfind("Window ") :]


def test_many_small_files_make_few_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "SAMPLES", 20, raising=False)
    want = {f"c{k}": [float(k)] * (k % 9) for k in range(300)}
    df = spark.createDataFrame([(k, v, 8000 + len(v)) for k, v in want.items()], "stem string, samples array<float>, sample_rate int")
    where = {r.stem: r.path for r in files.write_audio(df, f"file://{tmp_path}/wav").collect()}
    assert where.keys() == want.keys() and len({p.rpartition("/")[0] for p in where.values()}) > 10
    opened = spark.conf.get("spark.sql.files.openCostInBytes")
    got = files.read_audio(spark, f"file://{tmp_path}/wav")
    assert got.rdd.getNumPartitions() <= 5 and spark.conf.get("spark.sql.files.openCostInBytes") == opened
    rows = got.collect()
    assert len(rows) == 300 and {r.stem: r.samples for r in rows} == want and all(r.sample_rate == 8000 + len(r.samples) for r in rows)


def test_logs_and_atomic_writes(spark, tmp_path):
    log = tmp_path / "log.txt"
    log.write_text("a cafe 10\nb bus 5\n")
    assert files.read_condition_log(spark, str(log)).count() == 2
    log.write_text("a cafe\n")
    with pytest.raises(contracts.ContractError):
        files.read_condition_log(spark, str(log))
    out = tmp_path / "r.json"
    files.write_json(str(out), {"a": 1})
    with pytest.raises(ValueError):
        files.write_json(str(out), {"a": float("nan")})
    assert out.read_text() == '{\n  "a": 1\n}\n'
    lines = tmp_path / "rows.jsonl"
    lines.write_text('{"id": "x", "n": 1}\n\n{"id": "y", "n": 2}\n')
    assert files.read_jsonl(spark, str(lines), "id string, n int").count() == 2


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = []
    for stream in (1, 2):
        parts = np.array_split(rng.normal(size=700), 5)
        rows += [(stream, i, p.tolist(), i == 4, None) for i, p in enumerate(parts)]
    rng.shuffle(rows)
    rows = [(int(s), int(i), v, bool(e), None) for s, i, v, e, _ in rows]
    for k in range(3):
        spark.createDataFrame(rows[k::3], chunks.CHUNK).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    whole = spark.createDataFrame(rows, chunks.CHUNK)
    expected: dict = {}
    for r in chunks.overlap_add(whole, Framing(64, 16)).collect():
        expected.setdefault(r.stream, []).extend((r.seq, x) for x in r.samples)
    source = spark.readStream.schema(chunks.CHUNK).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    run = chunks.overlap_add(source, Framing(64, 16)).writeStream.format("memory").queryName("overlap").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination(120)
    got: dict = {}
    for r in spark.table("overlap").collect():
        got.setdefault(r.stream, []).extend((r.seq, x) for x in r.samples)
    for stream in (1, 2):
        batch, stream_values = ([x for _, x in sorted(side[stream], key=lambda t: t[0])] for side in (expected, got))
        original = np.concatenate([np.array(v) for s, i, v, *_ in sorted(rows, key=lambda r: r[1]) if s == stream])
        assert np.allclose(batch, original) and np.allclose(stream_values, original)


def test_endpoint_chunks(spark):
    p = [0.1, 0.8, 0.9, 0.7, 0.1, 0.1]
    df = spark.createDataFrame([(1, i, [v], i == 5, None) for i, v in enumerate(p)], chunks.CHUNK)
    got = chunks.endpoints(df, Endpoints(0.5, 0.5, 2, 2, 2, 1, 100)).collect()
    assert [(r.start_frame, r.end_frame, r.reason) for r in got] == [(0, 6, "silence")]
    with pytest.raises(Exception, match="came twice"):
        chunks.endpoints(df.union(df.filter(F.col("seq") == 1))).collect()


def test_review_candidates_are_places_of_a_sort(spark):
    import random

    rng = random.Random(3)
    for ids in ([f"p{rng.randrange(9)}_{i:03}" for i in range(150)], ["same prefix " + "x" * i for i in range(40)], ["é", "z", "a"], ["one"]):
        rows = [(s, i) for s in ("dev", "test", None) for i in ids]
        rng.shuffle(rows)
        got = sampling.review_candidates(spark.createDataFrame(rows, "split string, id string"), "split", "id").collect()
        ordered = sorted(ids, key=lambda x: x.encode())
        want = {ordered[0], ordered[len(ids) // 2], ordered[-1]}
        assert sorted((str(r.split), r.id) for r in got) == sorted((str(s), i) for s in ("dev", "test", None) for i in want)


def test_sets_of_manifests(spark):
    df = spark.createDataFrame([(3, "b"), (1, "a"), (2, "b"), (4, None), (5, None)], "n long, id string")
    assert [r.n for r in sampling.first_rows(df, "n", 2).collect()] == [1, 2]
    assert {(r.id, r.n) for r in sampling.distinct_in_order(df, ["id"], "n").collect()} == {("a", 1), ("b", 2), (None, 4)}
    other = spark.createDataFrame([("b",), ("c",)], "id string")
    assert {tuple(r) for r in sampling.missing_and_extra(df.filter("id is not null"), other, ["id"]).collect()} == {("a", "missing"), ("c", "extra")}
    assert sampling.missing_and_extra(other, other, ["id"]).count() == 0
