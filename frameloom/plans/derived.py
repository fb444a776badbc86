"""Relations that the queries run on, derived from the given tables; each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import words

#: condition: every how manyth word is dropped, changed, doubled
CONDITIONS = {"clean": (1_000_003, 11, 1_000_003), "noisy": (7, 5, 1_000_003), "classical": (9, 5, 8), "neural": (4, 6, 9)}
ORDER_CONDITIONS = ("noisy", "mild", "strong", "learned")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, condition, reference, hypothesis, speaker, noise, snr_db, duration_seconds) of every benchmark text under each condition."""
    conditions = spark.createDataFrame([(c, *m) for c, m in CONDITIONS.items()], "condition string, d int, s int, u int")
    df = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), words("text").alias("ws"))
    df = df.join(F.broadcast(conditions), F.lit(True))
    changed = F.expr("flatten(transform(ws, (w, i) -> CASE WHEN (i + 1) % d = 0 THEN cast(array() as array<string>) WHEN (i + 1) % s = 0 THEN array(concat(w, 'x')) WHEN (i + 1) % u = 0 THEN array(w, w) ELSE array(w) END))")
    return df.select(
        "id", "condition", F.array_join("ws", " ").alias("reference"), F.array_join(changed, " ").alias("hypothesis"),
        F.concat(F.lit("s"), F.col("id") % 5).alias("speaker"), F.when(F.col("id") % 7 != 0, F.concat(F.lit("n"), F.col("id") % 3)).alias("noise"),
        ((F.col("id") % 4) * 5.0).alias("snr_db"), (F.size("ws") / 3.0 + F.col("id") % 3).alias("duration_seconds"),
    )


_VALUES = ", ".join(f"('{c}', {d}, {s}, {u})" for c, (d, s, u) in CONDITIONS.items())
TRANSCRIPTS = f"""
conds(condition, d, s, u) AS (VALUES {_VALUES}),
texts AS (SELECT item_id AS id, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS ws FROM benchmark),
trans AS (
  SELECT id, condition, ws AS r, flatten(list_transform(range(1, len(ws) + 1), lambda i: CASE WHEN i % d = 0 THEN CAST([] AS VARCHAR[]) WHEN i % s = 0 THEN [ws[i] || 'x'] WHEN i % u = 0 THEN [ws[i], ws[i]] ELSE [ws[i]] END)) AS h,
         's' || (id % 5) AS speaker, CASE WHEN id % 7 <> 0 THEN 'n' || (id % 3) END AS noise, (id % 4) * 5.0::DOUBLE AS snr_db, len(ws) / 3.0::DOUBLE + id % 3 AS duration_seconds
  FROM texts, conds),
coded AS (SELECT *, list_distinct(list_concat(r, h)) AS vocab FROM trans),
scored AS (
  SELECT *, len(r) AS words, levenshtein(coalesce(array_to_string(list_transform(r, lambda w: chr(33 + list_position(vocab, w)::INT)), ''), ''), coalesce(array_to_string(list_transform(h, lambda w: chr(33 + list_position(vocab, w)::INT)), ''), '')) AS errors
  FROM coded)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, condition, value, errors, words, priority, status) of every order under each condition; whole numbers."""
    df = table(spark, sf_dir, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    rows = spark.createDataFrame(list(enumerate(ORDER_CONDITIONS)), "k int, condition string")
    k, key = F.col("k"), F.col("o_orderkey")
    df = df.join(F.broadcast(rows), F.lit(True))
    return df.select(
        key.alias("id"), "condition", ((F.col("cents") + k * 7919 * (key % 13)) % 5000 - 2500 + k * 40).alias("value"),
        ((key * (k + 3) + F.col("cents")) % 7).alias("errors"), (key % 20 + 5).alias("words"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"),
    )


SCORES = f"""
conds(k, condition) AS (VALUES {", ".join(f"({k}, '{c}')" for k, c in enumerate(ORDER_CONDITIONS))}),
cents AS (SELECT *, round(o_totalprice * 100)::BIGINT AS cents FROM orders),
scores AS (SELECT o_orderkey AS id, condition, (cents + k * 7919 * (o_orderkey % 13)) % 5000 - 2500 + k * 40 AS value, (o_orderkey * (k + 3) + cents) % 7 AS errors, o_orderkey % 20 + 5 AS words, o_orderpriority AS priority, o_orderstatus AS status FROM cents, conds)"""


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream, n, value): each user's events in order."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), (F.row_number().over(w) - 1).cast("long").alias("n"), "value")


SIGNAL = "signal AS (SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, value FROM events)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream, samples): every embedding as a stream of doubles."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("stream"), F.col("embedding").cast("array<double>").alias("samples"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream, reference, estimate, vad): each vector, itself with a tenth of its reverse added, and an activity for each 16 samples."""
    df = vectors(spark, sf_dir)
    return df.select("stream", F.col("samples").alias("reference"), F.zip_with("samples", F.reverse("samples"), lambda x, y: x + 0.1 * y).alias("estimate"), F.expr("transform(sequence(0, 3), i -> ((stream + i) % 5) / 4.0D)").alias("vad"))


PAIRS = """
vectors AS (SELECT vec_id AS stream, embedding::DOUBLE[] AS samples FROM embeddings),
pairs AS (SELECT stream, samples AS reference, list_transform(samples, lambda x, i: x + 0.1::DOUBLE * samples[len(samples) + 1 - i]) AS estimate, list_transform(range(0, 4), lambda i: ((stream + i) % 5) / 4.0::DOUBLE) AS vad FROM vectors)"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, speaker, noise, snr_db, split, num_samples) of every document."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("speaker"), F.col("lang").alias("noise"), ((F.col("doc_id") % 4) * 5.0).cast("string").alias("snr_db"),
        F.when(F.col("doc_id") % 3 == 0, "validation").otherwise("development").alias("split"), F.col("n_chars").alias("num_samples"),
    )


MANIFEST = "manifest AS (SELECT doc_id AS id, source AS speaker, lang AS noise, ((doc_id % 4) * 5.0::DOUBLE)::VARCHAR AS snr_db, CASE WHEN doc_id % 3 = 0 THEN 'validation' ELSE 'development' END AS split, n_chars AS num_samples FROM documents)"
