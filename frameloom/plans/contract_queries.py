"""Contracts as queries: the rows that break each, in tables that are made to break some."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import canonical
from ..operators import contracts
from .derived import table
from .queries import ORACLE_SQL, QUERIES, query

__all__ = ["ORACLE_SQL", "QUERIES"]


@query("SELECT doc_id, text IS NULL AS missing FROM documents WHERE doc_id % 17 = 0 AND (text IS NOT NULL OR doc_id % 34 = 0)")
def digest_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose stored digest is that of another text, or stands beside no text."""
    df = table(spark, sf_dir, "documents")
    other = F.when(F.col("doc_id") % 17 != 0, F.sha2("text", 256)).otherwise(F.when(F.col("text").isNotNull() | (F.col("doc_id") % 34 == 0), F.sha2(F.concat(F.coalesce("text", F.lit("")), F.lit("!")), 256)))
    return contracts.digest_mismatches(df.withColumn("digest", other), "text", "digest").select("doc_id", F.col("text").isNull().alias("missing"))


@query("""SELECT 'asr_seconds' AS "column", count(*) AS rows, count(*) FILTER (l_linenumber <> 3) AS present, count(*) FILTER (l_linenumber <> 3 AND l_discount <= 0) AS faulty FROM lineitem
UNION ALL SELECT 'duration', count(*), count(*), count(*) FILTER (l_quantity <= 0) FROM lineitem""")
def timing_audit(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") != 3, F.col("l_discount").cast("double")).alias("asr_seconds"), F.col("l_quantity").cast("double").alias("duration"))
    return contracts.partial_columns(df, ["asr_seconds", "duration"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 50 = 0 OR l_orderkey % 60 = 0 OR l_quantity <= 0")
def rate_audit(spark, sf_dir):
    """Rates that are a millionth and a half off, or missing; those that are off by a tenth of a millionth are the same."""
    seconds, of = F.col("l_extendedprice").cast("double"), F.col("l_quantity").cast("double")
    off = F.when(F.col("l_orderkey") % 50 == 0, 1 + 1.5e-6).when(F.col("l_orderkey") % 60 == 0, None).otherwise(1 + 1e-7)
    df = table(spark, sf_dir, "lineitem").withColumns({"seconds": seconds, "of": of, "rate": seconds / of * off})
    return contracts.inconsistent_rates(df, "rate", "seconds", "of").select("l_orderkey", "l_linenumber")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'not a number' WHEN o_orderkey % 5 = 0 THEN 'temperature' WHEN o_orderkey % 3 = 0 THEN 'order' ELSE 'probability' END AS fault
FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 OR o_orderkey % 11 = 0""")
def segment_audit(spark, sf_dir):
    """Of each order two segments, of which the second may be faulty."""
    k = F.col("o_orderkey")
    good = {c: F.lit(v) for c, v in zip(contracts.NUMBERS, (0.0, 1.0, 0.0, -0.5, 1.2, 0.25))}
    faulty = {"avg_logprob": F.when(k % 7 == 0, F.when(k % 2 == 0, float("nan"))).otherwise(-0.5), "temperature": F.when(k % 5 == 0, 0.2).otherwise(0.0), "end": F.when(k % 3 == 0, -1.0).otherwise(1.0), "no_speech_prob": F.when(k % 11 == 0, 1.5).otherwise(1.0)}
    segments = F.array(*(F.struct(*(v.alias(c) for c, v in s.items())) for s in (good, good | faulty)))
    df = table(spark, sf_dir, "orders").select("o_orderkey", segments.alias("segments"))
    return df.select("o_orderkey", contracts.segment_fault("segments").alias("fault")).filter("fault is not null")


_MANIFEST = """m AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 41 = 0 THEN 'a/b' WHEN c_custkey % 43 = 0 THEN 's1_dup' ELSE 's' || (c_custkey % 9) || '_' || c_custkey END AS id FROM customer),
r AS (SELECT k, id, CASE WHEN k % 13 = 0 THEN 'x' ELSE string_split(id, '_')[1] END AS speaker, CASE WHEN k % 17 <> 0 THEN '/c/' || id || '.wav' END AS clean, '/n/' || id || CASE WHEN k % 19 = 0 THEN '.b' ELSE '' END || '.wav' AS noisy FROM m)"""


@query(f"""WITH {_MANIFEST} SELECT id, 'missing clean' AS problem FROM r WHERE clean IS NULL UNION ALL SELECT id, 'unsafe id' FROM r WHERE contains(id, '/') UNION ALL SELECT id, 'speaker' FROM r WHERE speaker <> string_split(id, '_')[1]
UNION ALL SELECT id, 'clean name' FROM r WHERE clean IS NOT NULL AND contains(id, '/') UNION ALL SELECT id, 'noisy name' FROM r WHERE k % 19 = 0 OR contains(id, '/') UNION ALL SELECT id, 'duplicate' FROM r GROUP BY id HAVING count(*) > 1""")
def manifest_audit(spark, sf_dir):
    k = F.col("c_custkey")
    df = table(spark, sf_dir, "customer").withColumn("id", F.when(k % 41 == 0, "a/b").when(k % 43 == 0, "s1_dup").otherwise(F.concat(F.lit("s"), k % 9, F.lit("_"), k)))
    df = df.select(
        "id", F.when(k % 13 == 0, "x").otherwise(F.substring_index("id", "_", 1)).alias("speaker_id"), F.when(k % 17 != 0, F.concat(F.lit("/c/"), "id", F.lit(".wav"))).alias("clean"),
        F.concat(F.lit("/n/"), "id", F.when(k % 19 == 0, ".b").otherwise(""), F.lit(".wav")).alias("noisy"), F.lit(16000).alias("sample_rate"), k.alias("num_samples"), F.lit("dev").alias("split"), F.lit("cafe").alias("noise"), F.lit(5.0).alias("snr_db"),
    )
    return contracts.manifest_faults(df)


@query("SELECT conv_id, turn, field FROM (SELECT conv_id, turn, 'hypothesis' AS field FROM conversations WHERE turn % 3 = 0 UNION ALL SELECT conv_id, turn, 'text' FROM conversations WHERE text IS NOT NULL)")
def reserved_field_audit(spark, sf_dir):
    """Rows as JSON objects, of which some have fields that only results may have."""
    df = table(spark, sf_dir, "conversations")
    row = F.to_json(F.struct("conv_id", "text", F.when(F.col("turn") % 3 == 0, F.struct(F.col("role").alias("text"))).alias("hypothesis")))
    return contracts.reserved_fields(df.withColumn("row", row), "row", {"text", "hypothesis", "segments"}).select("conv_id", "turn", "field")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IS NULL OR o_orderstatus NOT IN ('F', 'O')")
def status_audit(spark, sf_dir):
    return contracts.others(table(spark, sf_dir, "orders"), "o_orderstatus", {"F", "O"}).select("o_orderkey", "o_orderstatus")


@query("""SELECT o_orderkey, sha256('{"a":{"key":' || o_orderkey || ',"tags":["' || o_orderpriority || '",null,"é\\n"]},"half":' || (o_orderkey // 2) || CASE WHEN o_orderkey % 2 = 0 THEN '.0' ELSE '.5' END || ',"status":"' || o_orderstatus || '"}') AS digest FROM orders""")
def canonical_digests(spark, sf_dir):
    """Digests of nested rows, whose fields are written in another order."""
    tags = F.array("o_orderpriority", F.lit(None), F.lit("é\n"))
    row = F.struct(F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") / 2).cast("double").alias("half"), F.struct(tags.alias("tags"), F.col("o_orderkey").alias("key")).alias("a"))
    df = table(spark, sf_dir, "orders").select("o_orderkey", row.alias("row"))
    return df.select("o_orderkey", canonical.canonical_digest(F.col("row"), df.schema["row"].dataType).alias("digest"))
