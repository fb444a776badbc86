"""Contracts that raise, and canonical JSON against Python's."""

import hashlib
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from frameloom.functions import canonical
from frameloom.operators import contracts, statistics
from frameloom.operators.contracts import ContractError
from frameloom.sources import files

SCHEMA = "b struct<z:double, a:array<double>>, a map<string,long>, c string, flag boolean, n long, none void"


def canonical_python(value):
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_canonical_json_of_nested_rows(spark):
    rows = [
        ({"z": 1.0, "a": [0.1, None, -2.5e-7]}, {"k": 3, "a": None, "é": -1}, 'q"uo\\te\n\t\u0001日', True, 2**60, None),
        ({"z": -0.0, "a": []}, {}, "", False, None, None),
        (None, None, None, None, 0, None),
        ({"z": None, "a": None}, {"B": 1, "a": 2, "\U0001f600": 3, "￿": 4}, "\x7f ", True, -5, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA).select(F.struct("*").alias("row"))
    kind = df.schema["row"].dataType
    want = [canonical_python(dict(zip(kind.names, r))) for r in rows]
    assert [r[0] for r in df.select(canonical.canonical_json(F.col("row"), kind)).collect()] == want
    digests = [hashlib.sha256(w.encode()).hexdigest() for w in want]
    found = df.select(canonical.canonical_digest(F.col("row"), kind))
    assert [r[0] for r in found.collect()] == digests and "Python" not in found._jdf.queryExecution().executedPlan().toString().replace("PythonRDD", "")


def test_numbers_are_written_as_python_writes_them(spark):
    rng = random.Random(3)
    bits = [struct.unpack("<d", rng.getrandbits(64).to_bytes(8, "little"))[0] for _ in range(6000)]
    values = [x for x in bits if x == x and abs(x) != float("inf")] + [rng.uniform(-1, 1) * 10 ** rng.randint(-9, 20) for _ in range(6000)] + [round(rng.random() * 100, 2) for _ in range(2000)]
    values += [0.0, -0.0, 1e16, 9999999999999998.0, 1e-4, 9.9e-5, 1e22, 1e23, 2e-3, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, 123456789012345680.0, 100.0, 0.5, 2.0**-1074 * 3]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    got = [r[0] for r in df.select(canonical.canonical_json(F.col("x"), df.schema["x"].dataType)).collect()]
    assert [(g, repr(x)) for g, x in zip(got, values) if g != repr(x)] == []
    for bad in (float("nan"), float("inf")):
        with pytest.raises(Exception, match="no such number"):
            spark.createDataFrame([(bad,)], "x double").select(canonical.canonical_json(F.col("x"), df.schema["x"].dataType)).collect()


def test_types_without_json_raise():
    from pyspark.sql.types import DateType

    with pytest.raises(TypeError):
        canonical.canonical_json(F.col("x"), DateType())


def test_contracts_raise_and_pass_their_rows_on(spark):
    good = {"start": 0.0, "end": 1.0, "temperature": 0.0, "avg_logprob": -0.5, "compression_ratio": 1.0, "no_speech_prob": 0.5}
    kind = "id string, segments array<struct<start:double,end:double,temperature:double,avg_logprob:double,compression_ratio:double,no_speech_prob:double>>"
    cases = {"not a number": {"start": None}, "temperature": {"temperature": 0.2}, "order": {"end": -1.0}, "probability": {"no_speech_prob": 1.01}}
    for fault, change in cases.items():
        df = spark.createDataFrame([("a", [good, good | change]), ("b", [good]), ("c", []), ("d", None)], kind)
        assert {r.id: r.fault for r in df.select("id", contracts.segment_fault("segments").alias("fault")).collect()} == {"a": fault, "b": None, "c": None, "d": None}
        with pytest.raises(ContractError):
            contracts.sound_segments(df, "id", "segments")
        assert contracts.sound_segments(df.filter("id <> 'a'"), "id", "segments").count() == 3
    assert spark.createDataFrame([("a", [good | {"temperature": 0.2}])], kind).select(contracts.segment_fault("segments", (0.0, 0.2)).alias("f")).first().f is None
    row = ("p1_2", "p1", "x/p1_2.wav", "y.d/p1_2.WAV", 16000, 5, "dev", "cafe", 5.0)
    names = "id string, speaker_id string, clean string, noisy string, sample_rate int, num_samples long, split string, noise string, snr_db double"
    assert contracts.safe_manifest(spark.createDataFrame([row], names)).count() == 1
    bad = [("", "", ".wav", "", *row[4:]), ("a/b", "a/b", "b.wav", "b.wav", *row[4:]), ("p2_1", "p1", "p2_1.wav", "p2_1", *row[4:7], None, None), row, row]
    found = {tuple(r) for r in contracts.manifest_faults(spark.createDataFrame(bad, names)).collect()}
    assert found == {("", "unsafe id"), ("", "clean name"), ("a/b", "unsafe id"), ("a/b", "clean name"), ("a/b", "noisy name"), ("p2_1", "speaker"), ("p2_1", "missing noise"), ("p2_1", "missing snr_db"), ("p1_2", "duplicate")}
    for df in (spark.createDataFrame(bad, names), spark.createDataFrame([], names)):
        with pytest.raises(ContractError):
            contracts.safe_manifest(df)
    text = spark.createDataFrame([("a", hashlib.sha256(b"a").hexdigest()), (None, None)], "t string, d string")
    assert contracts.digest_matches(text, "t", "d").count() == 2
    with pytest.raises(ContractError):
        contracts.digest_matches(text.withColumn("d", F.upper("d")), "t", "d")
    rates = spark.createDataFrame([(0.5, 1.0, 2.0), (0.5 + 4e-7, 1.0, 2.0)], "r double, s double, o double")
    assert contracts.consistent_rates(rates, "r", "s", "o").count() == 2
    for change in ({"r": F.lit(0.51)}, {"o": F.lit(0.0)}, {"s": F.lit(None).cast("double")}):
        with pytest.raises(ContractError):
            contracts.consistent_rates(rates.withColumns(change), "r", "s", "o")
    with pytest.raises(ContractError):
        contracts.only(text, "t", {"a"})
    assert contracts.only(text.filter("t = 'a'"), "t", {"a", "b"}).count() == 1
    with pytest.raises(ContractError):
        contracts.without(text, {"d"})


# A published table of metrics (files in order), and its published summary
PUBLISHED = {
    ("as_it_is", "si_sdri_db"): """
        -1.2303097776510938 1.5926035219107373 6.668421771924307 7.209413272727661 -3.767195381107806 -0.12870476633429817 5.197905279938232 4.3355809085436094 -3.331478590372347
        1.4217835166624937 3.089532747053317 7.528208974898378 -2.3496266822428975 1.9955138001287605 6.564187721969017 9.98100379265814 -4.830276876479303 2.1959284960346785
        4.079213496094054 6.50185274180533 -2.5704081833655703 1.6852664263401635 5.674018845519226 7.058981689407977 -4.660763118685097 1.6577762425203364 5.853990894367727
        4.600376873781668 -0.8390529483190896 1.4261826427538669
    """,
    ("as_it_is", "stoi_improvement"): """
        -0.017246900170488466 -0.015426610771612004 -0.012438125117631316 0.011555427992354095 -0.0036980052717400236 0.009049654485184133 0.0034891770779349462
        0.051941019590155624 -0.020909746088508374 -0.014876251105403138 -0.015036164706658361 0.012553183867749507 -0.03705584324490563 -0.021069293813000933
        -0.01791051578372993 -0.003872631924807468 -0.031669937848843865 0.0007141831870404181 0.0028751424893084243 0.017016532653892247 -0.0035911068093428256
        -0.043170329760305104 -0.015175668898165462 0.037437193775323396 -0.01132863230687775 0.0014218160358920873 -0.0011551485966533326 0.060636933930525716
        -0.022914911177481234 0.007516456860363063
    """,
    ("boosted_3db", "si_sdri_db"): """
        -1.2604665333626208 1.5408491913855134 6.549880835112702 7.1593771727841125 -3.8032942280833595 -0.17600923057224271 5.157882985997241 4.290790101552108 -3.3638405676225
        1.3140759821190109 2.9681954378642033 7.473978029819584 -2.4189763833517812 1.9040438833424833 6.424239141518255 9.890123585112896 -4.891147850148844 2.1187918162379056
        4.015772848459848 6.423707661889582 -2.6211148557478374 1.6134019895385592 5.511064383024987 7.001282572634129 -4.698902029502772 1.5863389234427334 5.823249680662474
        4.508606280806778 -0.9607981191604402 1.2898430283763371
    """,
    ("boosted_3db", "stoi_improvement"): """
        -0.01646829793087634 -0.017311400243086972 -0.013426036116450768 0.012178111489248966 -0.0053520714963132265 0.007777908709256431 0.0024749653139786165
        0.051256240060340796 -0.022095512032579645 -0.015862023808454362 -0.016460789523321973 0.011561603450460312 -0.03803741953017403 -0.021747997735298785
        -0.01918164973543668 -0.005205210695269469 -0.03191689849236523 -0.0010010547542631532 0.002390138423600363 0.01665062851573773 -0.004364640338134107 -0.043890563290373
        -0.01681859830032406 0.03709247634594759 -0.010912340362440709 0.0005452649129488174 0.005831092202747357 0.05745519198807347 -0.02345276629648907 0.006147988739217847
    """,
}
SUMMARY = {
    "as_it_is": {"si_sdri_db": (2.4203309110827393, 2.0957211480817195, 0.7), "stoi_improvement": (-0.003077970048347719, -0.003785318598273746, 0.4)},
    "boosted_3db": {"si_sdri_db": (2.3456981911376347, 2.0114178497901944, 0.7), "stoi_improvement": (-0.003738122017669776, -0.005278641095791348, 0.4)},
}


def test_published_metrics_have_their_published_summary(spark, tmp_path):
    """Metrics written as CSV, read with their schema and summarized by method."""
    columns = {m: list(zip(*(PUBLISHED[m, c].split() for c in ("si_sdri_db", "stoi_improvement")))) for m in SUMMARY}
    lines = ["method,si_sdri_db,stoi_improvement", *(f"{m},{a},{b}" for m, rows in columns.items() for a, b in rows)]
    (tmp_path / "metrics.csv").write_text("\n".join(lines) + "\n")
    df = files.read_metrics(spark, str(tmp_path / "metrics.csv"), "method string, si_sdri_db double, stoi_improvement double")
    for c, share in (("si_sdri_db", "positive"), ("stoi_improvement", "nonnegative")):
        for r in statistics.summary(df, c, [["method"]], 12).collect():
            assert (r.n, r["mean"], r.p50, r[share]) == (30, *(pytest.approx(x, abs=1e-11) for x in SUMMARY[r.method][c]))
