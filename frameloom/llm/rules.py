"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

A rule bounds the ratio of two counts of a text: ``least <= count / base <= most``, in per mille so that all comparisons are of
integers. Ratios of nothing (base 0) pass. The counts are those of ``counts``: whole texts, every word.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

GAP = r"[\x20\x09-\x0D]+"
WINDOW = 5

# Frequent function words of the corpus' languages, as written within and at the start of sentences
STOP_WORDS = (
    "the of and to in is was it for on that as with by at from this be are an or "
    "der die und das von zu mit den ist des sich nicht ein eine auch auf für als "
    "de la le les et des un une du dans est en que pour pas par au sur "
    "el los las y por con del al se su no lo para una"
).split()


class Rule(NamedTuple):
    name: str
    count: str
    base: str
    least: int | None
    most: int | None


#: In per mille of the base.
TABLE = (
    Rule("mean_word_length", "word_chars", "n_words", 1500, 14000),
    Rule("symbols_to_words", "n_symbols", "n_words", None, 100),
    Rule("stop_words", "n_stop_words", "n_words", 20, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 300),
)
LEAST_WORDS, MOST_REPEATED = 10, 20  # words; percent of words


def counts(documents: DataFrame) -> DataFrame:
    """doc_id and the counts of ``documents(doc_id, text)``, a row for each row; null is the empty text, a null doc_id stays, other columns are
    ignored. Each step's columns are used more than once in the next, so Spark computes them once; a step holds no more than it needs, words
    are hashed once, and places of windows are only made for texts in which a window comes again."""
    text = F.coalesce("text", F.lit(""))
    df = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"), F.btrim(text, F.lit(" \t\n\x0b\x0c\r")).alias("inner"))
    words = F.when(F.col("inner") == "", F.array().cast("array<string>")).otherwise(F.split("inner", GAP))
    df = df.select("doc_id", "t", words.alias("words"), F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "").alias("lines"))
    stops = sorted({x for w in STOP_WORDS for x in (w, w.capitalize())})
    df = df.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: w.isin(stops))).cast("long").alias("n_stop_words"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    windows = f"transform(slice(hashes, 1, greatest(size(hashes) - {WINDOW - 1}, 0)), (h, i) -> xxhash64(h, {', '.join(f'get(hashes, i + {k})' for k in range(1, WINDOW))}))"
    df = df.withColumn("windows", F.expr(windows)).drop("hashes")
    found = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("sorted", found).drop("windows")
    again = "filter(transform(sorted, (x, k) -> if(get(sorted, k - 1).h = x.h or get(sorted, k + 1).h = x.h, x.i, null)), i -> i is not null)"
    df = df.withColumn("places", F.expr(f"sort_array({again})")).drop("sorted")
    covered = f"aggregate(transform(places, (p, k) -> least({WINDOW}, coalesce(get(places, k + 1) - p, {WINDOW}))), 0L, (a, x) -> a + x)"
    return df.withColumn("n_repeat_words", F.coalesce(F.expr(covered), F.lit(0)).cast("long")).drop("places")


def passes(rule: Rule) -> Column:
    """Whether the rule holds."""
    ok = F.lit(True)
    if rule.least is not None:
        ok = ok & (F.col(rule.count) * 1000 >= F.col(rule.base) * rule.least)
    if rule.most is not None:
        ok = ok & (F.col(rule.count) * 1000 <= F.col(rule.base) * rule.most)
    return ok


def judge(counted: DataFrame, table: tuple[Rule, ...] = TABLE) -> DataFrame:
    """``counted`` with base_failed, kept and the names of the rules that failed, in the table's order."""
    base = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    verdict = F.lit(True)
    for rule in table:
        verdict = verdict & passes(rule)
    failed = F.array_compact(F.array(*(F.when(~passes(rule), F.lit(rule.name)) for rule in table))) if table else F.array().cast("array<string>")
    return counted.withColumns({"base_failed": base, "kept": ~base & verdict, "failed": failed})


OUT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))).select(*OUT)


def _sql_rule(rule: Rule) -> str:
    parts = [f"{rule.count} * 1000 >= {rule.base} * {rule.least}"] * (rule.least is not None) + [f"{rule.count} * 1000 <= {rule.base} * {rule.most}"] * (rule.most is not None)
    return " AND ".join(parts)


_STOPS = ", ".join(f"'{x}'" for x in sorted({x for w in STOP_WORDS for x in (w, w.capitalize())}))
OP3_SQL = rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (SELECT doc_id, i, words[i:i + {WINDOW - 1}] AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM base)),
again AS (SELECT doc_id, unnest(spots) AS i FROM (SELECT doc_id, list(i) AS spots FROM win GROUP BY doc_id, w HAVING count(*) > 1)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM again) GROUP BY doc_id),
counted AS (
  SELECT base.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(words, lambda x: x IN ({_STOPS})))::BIGINT AS n_stop_words
  FROM base LEFT JOIN covered ON base.doc_id = covered.doc_id),
failed AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM counted)
SELECT {', '.join(OUT[:6])}, base_failed, NOT base_failed AND {' AND '.join(_sql_rule(r) for r in TABLE)} AS kept FROM failed
"""
