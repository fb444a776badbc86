"""The queries by name, and the SQL that each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text
from ..functions.settings import Framing
from ..operators import contracts, counters, ordering, sampling, scoring, signals, statistics
from . import derived
from .derived import MANIFEST, PAIRS, SCORES, SIGNAL, TRANSCRIPTS, manifest, pairs, scores, signal, table, transcripts, vectors

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
SMALL = Framing(8, 4)
SHORT = Framing(16, 4)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Text -----------------------------------------------------------------------------------------------------------------


@query(f"""WITH {TRANSCRIPTS},
by_c AS (SELECT condition, count(*) AS utterances, sum(words)::BIGINT AS words, sum(errors)::BIGINT AS errors, sum(errors) / sum(words)::DOUBLE AS w FROM scored GROUP BY condition),
b AS (SELECT w AS b FROM by_c WHERE condition = 'noisy')
SELECT condition, utterances, words, errors, round(w, 6) AS wer, round(w - b, 6) AS delta, round((b - w) / nullif(b, 0), 6) AS relative_reduction FROM by_c, b""")
def corpus_wer_by_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.corpus_rates(scoring.score(transcripts(spark, sf_dir))).drop("substitutions", "deletions", "insertions")


@query()
def alignment_counts(spark, sf_dir):
    scored = scoring.score(transcripts(spark, sf_dir))
    return scored.select("id", "condition", "words", "errors", "substitutions", "deletions", "insertions")


_SETS = ("noise", "snr_db", "speaker", "length_bin")


@query(f"""WITH {TRANSCRIPTS},
cells AS (SELECT condition, errors, words, coalesce(noise, 'unknown') AS noise, coalesce(snr_db::VARCHAR, 'unknown') AS snr_db, speaker,
  CASE WHEN words <= 4 THEN '1-4' WHEN words <= 9 THEN '5-9' WHEN words <= 19 THEN '10-19' ELSE '20+' END AS length_bin FROM scored),
""" + "g AS (" + " UNION ALL ".join(f"SELECT '{s}' AS section, {c} AS stratum, condition, errors, words FROM cells" for s, c in (("overall", "'all'"), *((c, c) for c in _SETS))) + """)
SELECT section, stratum, condition, count(*) AS utterances, sum(words)::BIGINT AS words, sum(errors)::BIGINT AS errors, round(sum(errors) / sum(words)::DOUBLE, 6) AS wer FROM g GROUP BY ALL""")
def wer_grouping_sets(spark, sf_dir):
    scored = scoring.with_length_bin(scoring.score(transcripts(spark, sf_dir)))
    return scoring.stratified_rates(scored, list(_SETS)).drop("substitutions", "deletions", "insertions")


@query(f"WITH {TRANSCRIPTS} SELECT id, condition, round(errors / greatest(len(r), len(h))::DOUBLE, 6) AS distance FROM scored")
def word_distance(spark, sf_dir):
    df = transcripts(spark, sf_dir).withColumns({"r": text.words("reference"), "h": text.words("hypothesis")})
    return df.select("id", "condition", F.round(text.word_distance(text.alignment("r", "h")["c"], F.col("r"), F.col("h")), 6).alias("distance"))


_NGRAMS = """ws AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS w, row_number() OVER () AS k FROM conversations),
grams AS (SELECT k, w[i:i + 3] AS g FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 2, 1))) AS i FROM ws)),
again AS (SELECT k, sum(n) AS n FROM (SELECT k, g, count(*) AS n FROM grams GROUP BY k, g HAVING count(*) > 1) GROUP BY k)"""


@query(f"WITH {_NGRAMS} SELECT conv_id, turn, round(CASE WHEN len(w) < 4 THEN 0.0 ELSE coalesce(n, 0) / (len(w) - 3)::DOUBLE END, 6) AS fraction FROM ws LEFT JOIN again ON ws.k = again.k")
def repeated_ngram_fraction(spark, sf_dir):
    df = table(spark, sf_dir, "conversations").withColumn("w", text.words("text"))
    return df.select("conv_id", "turn", F.round(text.repeated_ngram_fraction("w", 4), 6).alias("fraction"))


def _hypotheses(spark, sf_dir) -> DataFrame:
    k = F.col("id")
    segment = F.struct(F.lit(0.0).alias("start"), (F.col("duration_seconds") + k % 4 * 0.1).alias("end"), (-0.2 - k % 6 * 0.2).alias("avg_logprob"), (1.0 + k % 8 * 0.25).alias("compression_ratio"), (k % 10 / 10.0).alias("no_speech_prob"))
    return transcripts(spark, sf_dir).withColumn("segments", F.when(k % 9 == 0, F.array().cast(f"array<struct<start:double,end:double,avg_logprob:double,compression_ratio:double,no_speech_prob:double>>")).otherwise(F.array(segment)))


_DIAGNOSIS = f"""{TRANSCRIPTS},
grams AS (SELECT id, condition, h[i:i + 3] AS g FROM (SELECT id, condition, h, unnest(range(1, greatest(len(h) - 2, 1))) AS i FROM trans)),
again AS (SELECT id, condition, sum(n) AS n FROM (SELECT id, condition, g, count(*) AS n FROM grams GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL),
rules AS (SELECT trans.*, trans.id % 9 <> 0 AS has, CASE WHEN len(h) < 4 THEN 0.0 ELSE coalesce(n, 0) / (len(h) - 3)::DOUBLE END AS repeated FROM trans LEFT JOIN again ON trans.id = again.id AND trans.condition = again.condition),
diagnosed AS (SELECT id, condition, h, speaker, list_filter([CASE WHEN NOT has THEN 'missing_segment_metadata' END, CASE WHEN has AND 1.0::DOUBLE + id % 8 * 0.25::DOUBLE > 2.4 THEN 'compression_ratio' END,
  CASE WHEN has AND -0.2::DOUBLE - id % 6 * 0.2::DOUBLE < -1.0 THEN 'low_average_logprob' END, CASE WHEN len(h) >= 8 AND repeated > 0.3 THEN 'repeated_ngram' END, CASE WHEN len(h) / duration_seconds > 6 THEN 'word_rate' END,
  CASE WHEN has AND id % 10 / 10.0::DOUBLE > 0.6 AND len(h) >= 3 THEN 'no_speech_text_conflict' END, CASE WHEN has AND duration_seconds + id % 4 * 0.1::DOUBLE > duration_seconds + 0.2 THEN 'invalid_timestamp' END], lambda x: x IS NOT NULL) AS reasons FROM rules)"""


@query(f"WITH {_DIAGNOSIS} SELECT id, condition, array_to_string(reasons, ',') AS reasons, len(reasons) > 0 AS anomalous FROM diagnosed")
def hypothesis_diagnosis(spark, sf_dir):
    return scoring.diagnose(_hypotheses(spark, sf_dir)).select("id", "condition", F.array_join("reasons", ",").alias("reasons"), "anomalous")


@query(f"WITH {_DIAGNOSIS} SELECT condition, reason, count(*) AS n FROM (SELECT condition, unnest(reasons) AS reason FROM diagnosed) GROUP BY ALL")
def reason_histogram(spark, sf_dir):
    return scoring.diagnose(_hypotheses(spark, sf_dir)).select("condition", F.explode("reasons").alias("reason")).groupBy("condition", "reason").agg(F.count("*").alias("n"))


def _decided(spark, sf_dir) -> DataFrame:
    df = transcripts(spark, sf_dir)
    k = F.col("id") + F.length("condition")
    retries = F.array(*(F.struct(F.concat("hypothesis", F.lit(f" r{i}")).alias("hypothesis"), (k % (i + 2) != 0).alias("anomalous")) for i in (1, 2)))
    df = df.withColumns({"anomalous": k % 2 == 0, "retries": retries})
    return scoring.decide(df, ["neural", "classical"], most_distance=0.3)


_DECISION = f"""{TRANSCRIPTS},
k AS (SELECT *, array_to_string(h, ' ') AS hyp, id + length(condition) AS k FROM scored),
tried AS (SELECT *, k % 2 = 0 AS bad, CASE WHEN k % 3 = 0 THEN hyp || ' r1' WHEN k % 4 = 0 THEN hyp || ' r2' END AS retry FROM k),
own AS (SELECT *, CASE WHEN NOT bad THEN 'first_pass' WHEN retry IS NOT NULL THEN 'temperature_retry' END AS src, CASE WHEN NOT bad THEN hyp ELSE retry END AS txt FROM tried),
base AS (SELECT id, txt AS b FROM own WHERE condition = 'noisy' AND src IS NOT NULL),
far AS (SELECT own.*, b, condition IN ('neural', 'classical') AND b IS NOT NULL AS can, string_split(txt, ' ') AS x, string_split(b, ' ') AS y, list_distinct(list_concat(string_split(txt, ' '), string_split(b, ' '))) AS v FROM own LEFT JOIN base ON own.id = base.id),
dist AS (SELECT *, CASE WHEN can AND src = 'temperature_retry' THEN round(levenshtein(array_to_string(list_transform(x, lambda w: chr(33 + list_position(v, w)::INT)), ''), array_to_string(list_transform(y, lambda w: chr(33 + list_position(v, w)::INT)), '')) / greatest(len(x), len(y))::DOUBLE, 6) END AS distance FROM far),
decided AS (SELECT *, CASE WHEN distance > 0.3 THEN 'noisy_fallback' WHEN src IS NOT NULL THEN src WHEN can THEN 'noisy_fallback' ELSE 'abstained' END AS final_source FROM dist)"""


@query(f"WITH {_DECISION} SELECT id, condition, distance, CASE WHEN final_source = 'abstained' THEN 'abstained' ELSE 'accepted' END AS final_status, final_source, CASE WHEN final_source = 'noisy_fallback' THEN b ELSE txt END AS final_hypothesis FROM decided")
def robust_decision(spark, sf_dir):
    return _decided(spark, sf_dir).select("id", "condition", "distance", "final_status", "final_source", "final_hypothesis")


@query(f"WITH {_DECISION} SELECT condition, final_source, count(*) AS n FROM decided GROUP BY ALL")
def source_histogram(spark, sf_dir):
    return _decided(spark, sf_dir).groupBy("condition", "final_source").agg(F.count("*").alias("n"))


_FINAL = "final AS (SELECT *, CASE WHEN (id + length(condition)) % 6 <> 0 THEN errors END AS final_errors FROM scored)"


@query(f"WITH {TRANSCRIPTS}, {_FINAL} SELECT condition, count(*) AS utterances, count(final_errors) AS accepted, round(count(final_errors) / count(*)::DOUBLE, 6) AS coverage, round(sum(final_errors) / sum(CASE WHEN final_errors IS NOT NULL THEN words END)::DOUBLE, 6) AS selective_wer, CASE WHEN count(final_errors) = count(*) THEN round(sum(final_errors) / sum(words)::DOUBLE, 6) END AS full_coverage_wer FROM final GROUP BY condition")
def selective_coverage(spark, sf_dir):
    scored = scoring.score(transcripts(spark, sf_dir))
    return scoring.selective(scored.withColumn("final_errors", F.when((F.col("id") + F.length("condition")) % 6 != 0, F.col("errors"))), ["condition"])


_RATIOS = "round({} / nullif({}, 0)::DOUBLE, 6)"
_CONFUSION = "count(*) FILTER (t AND g) AS tp, count(*) FILTER (NOT t AND g) AS fp, count(*) FILTER (t AND NOT g) AS fn, count(*) FILTER (NOT t AND NOT g) AS tn"


def _confusion_sql(empty: str) -> str:
    ratios = {"precision": ("tp", "(tp + fp)"), "recall": ("tp", "(tp + fn)"), "f1": ("2 * tp", "(2 * tp + fp + fn)"), "false_alarm": ("fp", "(fp + tn)"), "miss": ("fn", "(tp + fn)")}
    return ", ".join(f"coalesce({_RATIOS.format(*r)}, {empty}) AS {k}" for k, r in ratios.items())


@query(f"WITH {TRANSCRIPTS}, noisy AS (SELECT id, errors AS base FROM scored WHERE condition = 'noisy'), m AS (SELECT condition, errors > base AS t, (scored.id + words) % 3 = 0 AS g FROM scored JOIN noisy ON scored.id = noisy.id WHERE condition <> 'noisy'), c AS (SELECT condition, {_CONFUSION} FROM m GROUP BY condition) SELECT *, {_confusion_sql('NULL')} FROM c")
def detector_confusion(spark, sf_dir):
    scored = statistics.baseline_delta(scoring.score(transcripts(spark, sf_dir)), "id", "condition", "errors", "noisy").filter("condition <> 'noisy'")
    return scoring.confusion(scored, F.col("delta") > 0, (F.col("id") + F.col("words")) % 3 == 0, ["condition"])


@query(f"WITH {TRANSCRIPTS}, noisy AS (SELECT id, errors AS base FROM scored WHERE condition = 'noisy') SELECT condition, sum(least(errors, base))::BIGINT AS oracle_errors, round(sum(least(errors, base)) / sum(words)::DOUBLE, 6) AS oracle_wer FROM scored JOIN noisy ON scored.id = noisy.id GROUP BY condition")
def oracle_rates(spark, sf_dir):
    scored = statistics.baseline_delta(scoring.score(transcripts(spark, sf_dir)), "id", "condition", "errors", "noisy")
    best = F.least("errors", "baseline")
    return scored.groupBy("condition").agg(F.sum(best).alias("oracle_errors"), F.round(F.sum(best) / F.sum("words"), 6).alias("oracle_wer"))


@query(f"WITH {TRANSCRIPTS}, t AS (SELECT condition, duration_seconds AS d, (len(h) + 1) * 0.05::DOUBLE AS a, 0.01::DOUBLE * (id % 7) AS p FROM trans) SELECT condition, round(sum(a) / sum(d), 6) AS asr_rtf, round(sum(a + p) / sum(d), 6) AS end_to_end_rtf, round(quantile_cont(a / d, 0.5), 6) AS median_rtf, round(quantile_cont(a / d, 0.95), 6) AS p95_rtf, round(max(a / d), 6) AS max_rtf FROM t GROUP BY condition")
def rtf_latency(spark, sf_dir):
    df = transcripts(spark, sf_dir).select("condition", F.col("duration_seconds").alias("d"), ((F.size(text.words("hypothesis")) + 1) * 0.05).alias("a"), (0.01 * (F.col("id") % 7)).alias("p"))
    r = F.col("a") / F.col("d")
    return df.groupBy("condition").agg(F.round(F.sum("a") / F.sum("d"), 6).alias("asr_rtf"), F.round(F.sum(F.col("a") + F.col("p")) / F.sum("d"), 6).alias("end_to_end_rtf"), F.round(F.percentile(r, 0.5), 6).alias("median_rtf"), F.round(F.percentile(r, 0.95), 6).alias("p95_rtf"), F.round(F.max(r), 6).alias("max_rtf"))


@query("SELECT doc_id, lang, ('0x' || substr(sha256(concat_ws(chr(0), 'retry', doc_id::VARCHAR, lang, '0.2')), 1, 8))::BIGINT & 2147483647 AS seed FROM documents")
def retry_seeds(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", text.retry_seed(F.lit("retry"), F.col("doc_id").cast("string"), F.col("lang"), F.lit("0.2")).alias("seed"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents")
def text_digests(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


_SMALL = "abcdefghijklmnopqrstuvwxyz"


def _spoken(spark, sf_dir) -> DataFrame:
    """Transcripts as people write them: contractions, titles, remarks, thousands' commas, capitals, spelled numbers and regional spellings, differently on both sides."""
    spoken_id = F.expr(f"array({', '.join(map(repr, _COUNTED))})[cast(id % {len(_COUNTED)} as int)]")
    reference = F.concat(F.lit("Mr. Hill: \u201cIt's "), F.col("reference"), F.lit("\u201d, (laughs) won't cost 12,500 [noise] in colour, "), spoken_id)
    hypothesis = F.concat(F.lit("mister Hill it is "), F.translate("hypothesis", _SMALL, _SMALL.upper()), F.when(F.col("id") % 2 == 0, " will not cost 12500.").otherwise(" uh, won't cost 1,250"), F.lit(" in color "), F.col("id"), F.lit(" the 21st organized"))
    return transcripts(spark, sf_dir).withColumns({"reference": reference, "hypothesis": hypothesis})


#: spelled numbers, by id
_COUNTED = ("twenty-one thousand five hundred and six dollars", "the forty-third, organised", "three point one four million", "nineteen eighty four", "five dollars and seven cents", "a hundred percent", "one two three")
_ONE_OF = f"[{', '.join(map(repr, _COUNTED))}][(id % {len(_COUNTED)})::INT + 1]"


_R = text.normalized_english_sql(f"'Mr. Hill: \u201cIt''s ' || array_to_string(r, ' ') || '\u201d, (laughs) won''t cost 12,500 [noise] in colour, ' || {_ONE_OF}")
_H = text.normalized_english_sql(f"'mister Hill it is ' || translate(array_to_string(h, ' '), '{_SMALL}', '{_SMALL.upper()}') || CASE WHEN id % 2 = 0 THEN ' will not cost 12500.' ELSE ' uh, won''t cost 1,250' END || ' in color ' || id || ' the 21st organized'")


@query(f"WITH {TRANSCRIPTS} SELECT id, condition, {_R} AS reference, {_H} AS hypothesis FROM trans")
def english_normalized(spark, sf_dir):
    return _spoken(spark, sf_dir).select("id", "condition", *(text.normalized_english(c).alias(c) for c in ("reference", "hypothesis")))


@query(f"""WITH {TRANSCRIPTS}, n AS (SELECT condition, string_split({_R}, ' ') AS a, string_split({_H}, ' ') AS b FROM trans), v AS (SELECT *, list_distinct(list_concat(a, b)) AS v FROM n),
e AS (SELECT condition, len(a) AS words, levenshtein(array_to_string(list_transform(a, lambda w: chr(33 + list_position(v, w)::INT)), ''), array_to_string(list_transform(b, lambda w: chr(33 + list_position(v, w)::INT)), '')) AS errors FROM v)
SELECT condition, sum(words)::BIGINT AS words, sum(errors)::BIGINT AS errors, round(sum(errors) / sum(words)::DOUBLE, 6) AS wer FROM e GROUP BY condition""")
def normalized_wer(spark, sf_dir):
    df = _spoken(spark, sf_dir).withColumns({c: text.normalized_english(c) for c in ("reference", "hypothesis")})
    return scoring.corpus_rates(scoring.score(df)).select("condition", "words", "errors", "wer")


@query("SELECT count(*) AS rows, count(*) FILTER (quality = 0) AS poor, count(*) FILTER (toxic = 1) AS toxic FROM labels")
def run_counters(spark, sf_dir):
    """Counters that come with the pass that writes the rows."""
    df, seen = counters.counted(table(spark, sf_dir, "labels"), poor=F.col("quality") == 0, toxic=F.col("toxic") == 1)
    df.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([tuple(seen.get[c] for c in ("rows", "poor", "toxic"))], "rows long, poor long, toxic long")


@query(f"WITH {TRANSCRIPTS} SELECT condition, count(*) AS utterances, bool_and(len(r) > 0) AS passed FROM trans GROUP BY condition")
def frozen_experiment(spark, sf_dir):
    """Rows that pass the frozen experiment's contract; it raises otherwise."""
    df = transcripts(spark, sf_dir).withColumns({"device": F.lit("cpu"), "model": F.sha2(F.lit("model"), 256)})
    held = contracts.frozen_experiment(df, "id", "condition", set(derived.CONDITIONS), ["model"], ["speaker", "noise", "snr_db", "reference"], {"device": "cpu"})
    return held.groupBy("condition").agg(F.count("*").alias("utterances"), F.bool_and(F.col("reference") != "").alias("passed"))


# Paired scores --------------------------------------------------------------------------------------------------------

_DELTA = "d AS (SELECT *, max(CASE WHEN condition = 'noisy' THEN value END) OVER (PARTITION BY id) AS baseline, max(CASE WHEN condition = 'noisy' THEN errors END) OVER (PARTITION BY id) AS base_errors FROM scores)"


def _paired(spark, sf_dir) -> DataFrame:
    """Dealt by id once, for the windows of both baselines."""
    df = statistics.baseline_delta(ordering.dealt(scores(spark, sf_dir), "id"), "id", "condition", "errors", "noisy").withColumnsRenamed({"baseline": "base_errors", "delta": "error_delta"})
    return statistics.baseline_delta(df, "id", "condition", "value", "noisy")


@query(f"WITH {SCORES}, {_DELTA} SELECT id, condition, value, baseline, value - baseline AS delta FROM d")
def paired_delta(spark, sf_dir):
    return _paired(spark, sf_dir).select("id", "condition", "value", "baseline", "delta")


_SUMMARY = "count(*) AS n, round(avg(value), 6) AS mean, " + ", ".join(f"round(quantile_cont(value, {p / 100}), 6) AS p{p}" for p in (10, 25, 50, 75, 90, 95)) + ", round(avg((value > 0)::INT), 6) AS positive, round(avg((value >= 0)::INT), 6) AS nonnegative"


@query(f"WITH {SCORES} " + " UNION ALL ".join(f"SELECT condition, {p} AS priority, {s} AS status, {_SUMMARY}, {k}::INT AS level FROM scores GROUP BY ALL" for k, (p, s) in enumerate((("NULL", "NULL"), ("priority", "NULL"), ("NULL", "status")))))
def summary_by_condition(spark, sf_dir):
    return statistics.summary(scores(spark, sf_dir), "value", [["condition"], ["condition", "priority"], ["condition", "status"]])


_RANK = lambda v: f"rank() OVER (PARTITION BY condition ORDER BY {v}) + (count(*) OVER (PARTITION BY condition, {v}) - 1) / 2.0"


@query(f"WITH {SCORES}, r AS (SELECT *, {_RANK('value')} AS x, {_RANK('errors')} AS y FROM scores) SELECT condition, count(*) AS n, round(corr(value, errors), 6) AS pearson, round(corr(x, y), 6) AS spearman FROM r GROUP BY condition")
def rank_correlation(spark, sf_dir):
    return statistics.correlations(scores(spark, sf_dir), "value", "errors", ["condition"])


@query(f"WITH {SCORES}, {_DELTA}, e AS (SELECT *, value - baseline AS m, errors - base_errors AS e, -(errors - base_errors) AS b FROM d WHERE condition <> 'noisy'), r AS (SELECT *, {_RANK('m')} AS x, {_RANK('b')} AS y FROM e) SELECT condition, count(*) AS utterances, count(*) FILTER (e < 0) AS improved, count(*) FILTER (e = 0) AS equal, count(*) FILTER (e > 0) AS harmed, count(*) FILTER (m > 0) AS score_improved, count(*) FILTER (m > 0 AND e > 0) AS conflicts, round(count(*) FILTER (m > 0 AND e > 0) / count(*)::DOUBLE, 6) AS conflict_fraction, round(count(*) FILTER (m > 0 AND e > 0) / count(*) FILTER (m > 0)::DOUBLE, 6) AS harmed_among_improved, round(count(*) FILTER (m > 0 AND e > 0) / count(*) FILTER (e > 0)::DOUBLE, 6) AS improved_among_harmed, round(corr(m, b), 6) AS pearson, round(corr(x, y), 6) AS spearman FROM r GROUP BY condition")
def metric_alignment(spark, sf_dir):
    return statistics.alignment_report(_paired(spark, sf_dir).filter("condition <> 'noisy'"), "delta", "error_delta", ["condition"])


@query(f"WITH {SCORES}, {_DELTA} SELECT condition, priority, count(*) FILTER (errors < base_errors) AS better, count(*) FILTER (errors = base_errors) AS equal, count(*) FILTER (errors > base_errors) AS worse FROM d GROUP BY ALL")
def direction_counts(spark, sf_dir):
    return statistics.directions(_paired(spark, sf_dir), "error_delta", ["condition", "priority"])


@query(f"WITH {SCORES}, {_DELTA}, g AS (SELECT condition, priority, sum(errors) AS e, sum(base_errors) AS b, sum(words) AS w FROM d GROUP BY ALL), a AS (SELECT *, (sum(e) OVER o - e - sum(b) OVER o + b) / (sum(w) OVER o - w)::DOUBLE AS dw, (sum(e) OVER o - sum(b) OVER o) / (sum(w) OVER o)::DOUBLE AS da FROM g WINDOW o AS (PARTITION BY condition)) SELECT condition, priority, round(dw, 6) AS delta_without, round(da, 6) AS delta, sign(dw) = sign(da) AS same_direction FROM a")
def leave_one_group_out(spark, sf_dir):
    return statistics.leave_one_out(_paired(spark, sf_dir), "priority", "errors", "base_errors", "words", ["condition"])


@query(f"WITH {SCORES}, {_DELTA}, r AS (SELECT condition, id, errors - base_errors AS error_delta, row_number() OVER (PARTITION BY condition ORDER BY abs(errors - base_errors) DESC, id) AS k FROM d) SELECT condition, id, error_delta FROM r WHERE k = 1")
def most_influential(spark, sf_dir):
    return statistics.most_influential(_paired(spark, sf_dir), "id", "error_delta", ["condition"]).select("condition", "id", "error_delta")


@query(f"WITH {SCORES}, {_DELTA}, r AS (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY abs(errors - base_errors) DESC, id) AS k FROM d) SELECT condition, round(sum(errors - base_errors) / sum(words)::DOUBLE, 6) AS delta FROM r WHERE k > 1 GROUP BY condition")
def most_influential_removed(spark, sf_dir):
    df = _paired(spark, sf_dir)
    top = statistics.most_influential(df, "id", "error_delta", ["condition"]).select("condition", "id")
    return df.join(F.broadcast(top), ["condition", "id"], "left_anti").groupBy("condition").agg(F.round(F.sum("error_delta") / F.sum("words"), 6).alias("delta"))


@query(f"WITH {SCORES}, {_DELTA} SELECT condition, status = 'F' AS inside, round(sum(errors - base_errors) / sum(words)::DOUBLE, 6) AS delta FROM d GROUP BY ALL")
def split_by_group(spark, sf_dir):
    return _paired(spark, sf_dir).groupBy("condition", (F.col("status") == "F").alias("inside")).agg(F.round(F.sum("error_delta") / F.sum("words"), 6).alias("delta"))


_DRAWS = 200


@query(f"""WITH {TRANSCRIPTS}, p AS (SELECT row_number() OVER (ORDER BY a.id) - 1 AS place, a.errors - b.errors AS d, a.words AS t, count(*) OVER () AS n FROM scored a JOIN scored b ON a.id = b.id AND a.condition = 'neural' AND b.condition = 'noisy'),
slots AS (SELECT draw, slot, n FROM range({_DRAWS}) AS x(draw), (SELECT place AS slot, n FROM p)),
picked AS (SELECT draw, ('0x' || substr(md5('17:' || draw || ':' || slot), 1, 8))::BIGINT % n AS place FROM slots),
each AS (SELECT draw, sum(d) / sum(t)::DOUBLE AS delta FROM picked JOIN p ON picked.place = p.place GROUP BY draw)
SELECT round(quantile_cont(delta, 0.025), 6) AS lower, round(quantile_cont(delta, 0.975), 6) AS upper, count(*) AS draws FROM each""")
def paired_bootstrap_ci(spark, sf_dir):
    df = statistics.baseline_delta(scoring.score(transcripts(spark, sf_dir)), "id", "condition", "errors", "noisy").filter("condition = 'neural'")
    return statistics.paired_bootstrap(df, "id", "errors", "baseline", "words", _DRAWS, 17)


@query()
def bootstrap_generators(spark, sf_dir):
    df = statistics.baseline_delta(scoring.score(transcripts(spark, sf_dir)), "id", "condition", "errors", "noisy").filter("condition = 'neural'")
    each = [statistics.paired_bootstrap(df, "id", "errors", "baseline", "words", _DRAWS, 17, g).withColumn("generator", F.lit(g)) for g in ("python", "numpy", "choice")]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query(f"WITH {SCORES}, g AS (SELECT priority, status, avg(value) AS mean, median(value) AS median, count(*) FILTER (value < 0) AS negative FROM scores GROUP BY ALL) SELECT priority, status, round(mean, 6) AS mean, round(median, 6) AS median, negative, row_number() OVER (ORDER BY mean DESC, median DESC, negative, priority, status) AS place FROM g")
def grid_ranking(spark, sf_dir):
    from pyspark.sql import Window

    g = scores(spark, sf_dir).groupBy("priority", "status").agg(F.mean("value").alias("mean"), F.percentile("value", 0.5).alias("median"), F.count_if(F.col("value") < 0).alias("negative"))
    place = F.row_number().over(Window.orderBy(F.desc("mean"), F.desc("median"), "negative", "priority", "status"))
    return g.select("priority", "status", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "negative", place.cast("long").alias("place"))


# Manifests ------------------------------------------------------------------------------------------------------------


@query(f"WITH {MANIFEST}, r AS (SELECT *, row_number() OVER (PARTITION BY noise, snr_db ORDER BY sha256('20260724' || chr(0) || id), id) AS k FROM manifest) SELECT id, noise, snr_db FROM r WHERE k <= 2")
def stratified_sample(spark, sf_dir):
    return sampling.by_strata(manifest(spark, sf_dir), ["noise", "snr_db"], "id", 2, 20260724).select("id", "noise", "snr_db")


@query(f"WITH {MANIFEST}, c AS (SELECT noise, snr_db, count(*) AS n FROM manifest GROUP BY ALL) SELECT count(*) AS cells, count(DISTINCT noise) * count(DISTINCT snr_db) AS expected, count(*) FILTER (n <> 2) AS off FROM c")
def stratum_coverage(spark, sf_dir):
    return sampling.coverage(manifest(spark, sf_dir), ["noise", "snr_db"], 2)


@query()
def balanced_sample(spark, sf_dir):
    return sampling.by_speaker(manifest(spark, sf_dir), "speaker", "id", 5, 20260724)


@query()
def speaker_split(spark, sf_dir):
    return sampling.split_speakers(manifest(spark, sf_dir).drop("split"), "speaker", 20260724, fraction=0.8)


@query(f"WITH {MANIFEST}, r AS (SELECT split, id, row_number() OVER (PARTITION BY split ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY split) AS n FROM manifest) SELECT split, id FROM r WHERE i = 0 OR i = n // 2 OR i = n - 1")
def review_candidates(spark, sf_dir):
    return sampling.review_candidates(manifest(spark, sf_dir), "split", "id").select("split", "id")


@query(f"WITH {MANIFEST} SELECT id, split FROM manifest ORDER BY id LIMIT 25")
def manifest_limit(spark, sf_dir):
    return sampling.first_rows(manifest(spark, sf_dir), "id", 25).select("id", "split")


@query(f"WITH {MANIFEST} SELECT id, split, snr_db, NULL AS toxic FROM manifest UNION ALL SELECT doc_id, 'labelled', NULL, toxic FROM labels")
def manifest_union(spark, sf_dir):
    """Manifests of different columns one after the other; what one lacks is null."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit("labelled").alias("split"), "toxic")
    return manifest(spark, sf_dir).select("id", "split", "snr_db").unionByName(labels, allowMissingColumns=True)


@query("SELECT DISTINCT o_custkey AS custkey, 'missing' AS side FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) UNION ALL SELECT c_custkey, 'extra' FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)")
def missing_and_extra(spark, sf_dir):
    expected = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"))
    found = table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("custkey"))
    return sampling.missing_and_extra(expected, found, ["custkey"])


@query("SELECT source, lang, min(doc_id) AS doc_id FROM documents GROUP BY source, lang")
def distinct_in_order(spark, sf_dir):
    return sampling.distinct_in_order(table(spark, sf_dir, "documents"), ["source", "lang"], "doc_id")


@query("WITH s AS (SELECT o_orderkey, count(*) FILTER (l_discount > 0.05) AS n, max(l_discount::DOUBLE) AS most FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, l_orderkey) SELECT o_orderkey, CASE WHEN most IS NOT NULL THEN n > 0 END AS anomalous, CASE WHEN most IS NOT NULL THEN n END AS \"count\", most FROM s")
def compression_flags(spark, sf_dir):
    """Orders' lines as segments; orders without lines have none."""
    ratio = F.struct(F.col("l_discount").cast("double").alias("compression_ratio"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(ratio).alias("segments"))
    df = table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left")
    return df.select("o_orderkey", scoring.compression_anomaly(0.05).alias("c")).select("o_orderkey", "c.*")


@query("SELECT l_orderkey, l_linenumber, ceil(l_quantity::DOUBLE * 7 / 10)::BIGINT AS frames, round(ceil(l_quantity::DOUBLE * 7 / 10) * 0.01, 6) AS seconds FROM lineitem")
def frame_counts(spark, sf_dir):
    """Milliseconds as frames of ten, begun ones counted, and these as seconds."""
    frames = signals.frames_of_milliseconds(F.col("l_quantity").cast("double") * 7)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", frames.alias("frames"), F.round(frames * 0.01, 6).alias("seconds"))


@query("WITH f AS (SELECT conv_id FROM (SELECT conv_id, min(turn * 1000000 + conv_id) AS o FROM conversations GROUP BY conv_id) ORDER BY o, conv_id LIMIT 20) SELECT conv_id, turn FROM conversations WHERE conv_id IN (SELECT conv_id FROM f)")
def first_utterances(spark, sf_dir):
    df = table(spark, sf_dir, "conversations").withColumn("ordinal", F.col("turn") * 1000000 + F.col("conv_id"))
    return sampling.first_utterances(df, "conv_id", "ordinal", 20).select("conv_id", "turn")


@query(f"WITH {MANIFEST} SELECT split, count(*) AS pairs, count(DISTINCT speaker) AS speakers, round(sum(num_samples) / 16000.0 / 3600, 6) AS hours FROM manifest GROUP BY split")
def partition_audit(spark, sf_dir):
    return sampling.partition_summary(manifest(spark, sf_dir), "split", "speaker", "num_samples")


@query(f"WITH {MANIFEST} SELECT speaker, string_agg(DISTINCT split, ',' ORDER BY split) AS partitions FROM manifest GROUP BY speaker HAVING count(DISTINCT split) > 1")
def leakage_audit(spark, sf_dir):
    return sampling.leakage(manifest(spark, sf_dir), "split", "speaker")


@query("SELECT doc_id, side FROM (SELECT DISTINCT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))")
def pairing_audit(spark, sf_dir):
    return contracts.orphans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_audit(spark, sf_dir):
    return contracts.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("WITH n AS (SELECT count(DISTINCT turn) AS e FROM conversations), h AS (SELECT conv_id, count(DISTINCT turn) AS conditions FROM conversations GROUP BY conv_id) SELECT conv_id, conditions, e AS expected FROM h, n WHERE conditions <> e")
def unpaired_audit(spark, sf_dir):
    return contracts.unpaired(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query("SELECT source FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1 OR (count(lang) > 0 AND count(lang) < count(*))")
def varying_metadata(spark, sf_dir):
    return contracts.varying(table(spark, sf_dir, "documents"), "source", ["lang"])


@query("WITH a AS (SELECT doc_id, lang AS v FROM documents), b AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'xx' ELSE lang END AS v FROM documents WHERE doc_id % 50 <> 1), j AS (SELECT a.v AS x, b.v AS y, a.doc_id AS i, b.doc_id AS k FROM a FULL JOIN b ON a.doc_id = b.doc_id) SELECT count(*) AS pairs, count(*) FILTER (x IS NOT DISTINCT FROM y) AS matches, count(*) FILTER (i IS NULL OR k IS NULL) AS unpaired, bool_and(x IS NOT DISTINCT FROM y AND i IS NOT NULL AND k IS NOT NULL) AS passed FROM j")
def identity_match(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    other = df.filter("doc_id % 50 <> 1").withColumn("lang", F.when(F.col("doc_id") % 10 == 0, "xx").otherwise(F.col("lang")))
    return sampling.compare(df, other, ["doc_id"], "lang")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0 OR doc_id % 7 = 0")
def incremental_recompute(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    cached = df.filter("doc_id % 3 <> 0").withColumn("digest", F.when(F.col("doc_id") % 7 == 0, "stale").otherwise(F.col("digest")))
    return sampling.incremental(df, cached, ["doc_id", "digest"])[1].select("doc_id")


# Streams --------------------------------------------------------------------------------------------------------------

_FRAMES = f"""{SIGNAL}, sizes AS (SELECT stream, count(*) AS size FROM signal GROUP BY stream),
frames AS (SELECT stream, size, unnest(range(0, (greatest(ceil((size - {SMALL.length}) / {SMALL.hop}.0), 0) + 1)::BIGINT)) AS frame FROM sizes),
energy AS (SELECT f.stream, frame, count(*) AS samples, round(greatest(10 * log10(sum(value * value) / {SMALL.length} + 2.2250738585072014e-308), -120.0), 6) AS energy_db FROM frames f JOIN signal s ON f.stream = s.stream AND n >= frame * {SMALL.hop} AND n < frame * {SMALL.hop} + {SMALL.length} GROUP BY ALL)"""


@query(f"WITH {_FRAMES} SELECT f.stream, frame, n - frame * {SMALL.hop} AS \"offset\", value FROM frames f JOIN signal s ON f.stream = s.stream AND n >= frame * {SMALL.hop} AND n < frame * {SMALL.hop} + {SMALL.length}")
def frames(spark, sf_dir):
    return signals.frame_members(signal(spark, sf_dir), SMALL)


@query(f"WITH {_FRAMES} SELECT * FROM energy")
def frame_energy_db(spark, sf_dir):
    return signals.frame_energy(signal(spark, sf_dir), SMALL)


@query(f"WITH {SIGNAL} SELECT stream, n // 16 AS block, count(*) AS samples, round(sqrt(avg(value * value)), 6) AS rms FROM signal GROUP BY ALL")
def block_rms(spark, sf_dir):
    return signals.tumbling(signal(spark, sf_dir), 16)


@query("WITH v AS (SELECT vec_id AS stream, embedding::DOUBLE[] AS s FROM embeddings), w AS (SELECT stream, s, unnest(range(0, (128 - 96) // 16 + 1)) AS k FROM v) SELECT stream, k::INT AS \"window\", round(list_sum(list_transform(range(0, 96), lambda i: s[(k * 16 + i) % 64 + 1] * (i + 1))), 6) AS weighted FROM w")
def hop_windows(spark, sf_dir):
    df = signals.repeated_windows(vectors(spark, sf_dir), 96, 16)
    return df.select("stream", "window", F.round(F.expr("aggregate(transform(values, (x, i) -> x * (i + 1)), 0D, (a, x) -> a + x)"), 6).alias("weighted"))


@query(f"WITH {SIGNAL} SELECT stream, n, round(min(value) OVER (PARTITION BY stream ORDER BY n ROWS 9 PRECEDING), 6) AS trailing FROM signal")
def trailing_minimum(spark, sf_dir):
    return signals.trailing(signal(spark, sf_dir), "value", 10).select("stream", "n", "trailing")


@query(f"WITH {SIGNAL} SELECT stream, n, round(quantile_cont(value, 0.2) OVER (PARTITION BY stream ORDER BY n ROWS 19 PRECEDING), 6) AS trailing FROM signal")
def noise_floor_percentile(spark, sf_dir):
    return signals.trailing(signal(spark, sf_dir), "value", 20, 0.2).select("stream", "n", "trailing")


@query(f"WITH RECURSIVE {SIGNAL}, e AS (SELECT stream, n, 0.9::DOUBLE * value + (1 - 0.9::DOUBLE) * value AS ema FROM signal WHERE n = 0 UNION ALL SELECT s.stream, s.n, 0.9::DOUBLE * e.ema + (1 - 0.9::DOUBLE) * s.value FROM e JOIN signal s ON s.stream = e.stream AND s.n = e.n + 1) SELECT stream, n, round(ema, 6) AS ema FROM e")
def noise_floor_ema(spark, sf_dir):
    df = signals.ema(signal(spark, sf_dir), "value", 0.9)
    return df.select("stream", "n", F.round("ema", 6).alias("ema"))


@query(f"WITH RECURSIVE {SIGNAL}, e AS (SELECT stream, n, CASE WHEN value > 50 THEN 0.98::DOUBLE * 50 + (1 - 0.98::DOUBLE) * value ELSE 0.8::DOUBLE * 50 + (1 - 0.8::DOUBLE) * value END AS y FROM signal WHERE n = 0 UNION ALL SELECT s.stream, s.n, CASE WHEN s.value > y THEN 0.98::DOUBLE * y + (1 - 0.98::DOUBLE) * s.value ELSE 0.8::DOUBLE * y + (1 - 0.8::DOUBLE) * s.value END FROM e JOIN signal s ON s.stream = e.stream AND s.n = e.n + 1) SELECT stream, n, round(y, 6) AS floor FROM e")
def asymmetric_floor(spark, sf_dir):
    df = signals.asymmetric_ema(signal(spark, sf_dir), "value", 0.98, 0.8, 50.0)
    return df.select("stream", "n", F.round("floor", 6).alias("floor"))


_ISLANDS = f"""{SIGNAL}, l AS (SELECT *, value > 60 AS label, n - row_number() OVER (PARTITION BY stream, value > 60 ORDER BY n) AS i FROM signal), runs AS (SELECT stream, min(n) AS start, max(n) + 1 AS stop FROM l WHERE label GROUP BY stream, i)"""


@query(f"WITH {_ISLANDS} SELECT runs.stream, start * 4 AS start, least(size, (stop - 1) * 4 + 8) AS stop FROM runs JOIN (SELECT stream, count(*) * 4 AS size FROM signal GROUP BY stream) z ON runs.stream = z.stream")
def activity_segments(spark, sf_dir):
    df = signal(spark, sf_dir).withColumn("label", F.col("value") > 60)
    return signals.segments(df, "label", SMALL, df.groupBy("stream").agg((F.count("*") * 4).alias("size")))


@query(f"WITH {_ISLANDS} SELECT stream, n, label AND count(*) OVER (PARTITION BY stream, label, i) >= 3 AS kept FROM l")
def short_region_filter(spark, sf_dir):
    df = signal(spark, sf_dir).withColumn("label", F.col("value") > 60)
    return signals.drop_short(df, "label", 3).select("stream", "n", "kept")


_LABELS = f"{_FRAMES}, l AS (SELECT *, n - row_number() OVER (PARTITION BY stream, value > 60 ORDER BY n) AS i FROM signal), runs AS (SELECT stream, min(n) AS start, max(n) + 1 AS stop FROM l WHERE value > 60 GROUP BY stream, i), active AS (SELECT f.stream, f.frame, coalesce(bool_or(r.start IS NOT NULL), false) AS active FROM frames f LEFT JOIN runs r ON f.stream = r.stream AND frame * {SMALL.hop} < stop AND start < frame * {SMALL.hop} + {SMALL.length} GROUP BY ALL)"


def _active(spark, sf_dir) -> DataFrame:
    df = signal(spark, sf_dir)
    runs = signals.islands(df.withColumn("label", F.col("value") > 60), "label")
    return signals.interval_labels(signals.frame_energy(df, SMALL), runs, SMALL)


@query(f"WITH {_LABELS} SELECT * FROM active")
def interval_labels(spark, sf_dir):
    return _active(spark, sf_dir).select("stream", "frame", "active")


@query(f"WITH {_LABELS}, m AS (SELECT a.stream, active AS t, energy_db > 34 AS g FROM active a JOIN energy e ON a.stream = e.stream AND a.frame = e.frame), c AS (SELECT stream, {_CONFUSION} FROM m GROUP BY stream) SELECT *, {_confusion_sql('0.0')} FROM c")
def binary_activity_metrics(spark, sf_dir):
    return scoring.confusion(_active(spark, sf_dir), F.col("active"), F.col("energy_db") > 34, ["stream"], 0.0)


@query(f"WITH {_LABELS}, m AS (SELECT a.stream, active AS t, energy_db > 34 AS g FROM active a JOIN energy e ON a.stream = e.stream AND a.frame = e.frame), c AS (SELECT stream, {_CONFUSION} FROM m GROUP BY stream), r AS (SELECT *, {_confusion_sql('0.0')} FROM c) SELECT count(*) AS streams, round(avg(precision), 5) AS precision, round(avg(recall), 5) AS recall, round(avg(f1), 5) AS f1 FROM r")
def macro_activity_metrics(spark, sf_dir):
    each = scoring.confusion(_active(spark, sf_dir), F.col("active"), F.col("energy_db") > 34, ["stream"], 0.0)
    return each.agg(F.count("*").alias("streams"), *(F.round(F.avg(c), 5).alias(c) for c in ("precision", "recall", "f1")))


_LIST = lambda e: f"list_sum(list_transform({e}, lambda x, i: x * i))"


def _weighted(c):
    return F.round(F.aggregate(F.transform(c, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x), 6)


@query(f"WITH {PAIRS} SELECT stream, round({_LIST('list_transform(reference, lambda x, i: 0.7::DOUBLE * estimate[i] + (1 - 0.7::DOUBLE) * x)')}, 6) AS weighted FROM pairs")
def residual_mix(spark, sf_dir):
    df = pairs(spark, sf_dir).select("stream", signals.residual_mix(0.7, "estimate", "reference").alias("y"))
    return df.select("stream", _weighted("y").alias("weighted"))


@query(f"WITH {PAIRS}, m AS (SELECT stream, list_transform(reference, lambda x, i: (1 - 0.4::DOUBLE * vad[least((i - 1) // 16, 3) + 1]) * estimate[i] + 0.4::DOUBLE * vad[least((i - 1) // 16, 3) + 1] * x) AS y FROM pairs) SELECT stream, round({_LIST('y')}, 6) AS weighted FROM m")
def activity_mix(spark, sf_dir):
    df = pairs(spark, sf_dir).select("stream", signals.activity_mix(0.4, 16, "estimate", "reference").alias("y"))
    return df.select("stream", _weighted("y").alias("weighted"))


@query(f"WITH {PAIRS} SELECT stream, round({_LIST('list_transform(reference, lambda x, i: coalesce(reference[i + 5], 0))')}, 6) AS weighted FROM pairs")
def delay_compensate(spark, sf_dir):
    return pairs(spark, sf_dir).select("stream", _weighted(signals.delay_compensated("reference", 5)).alias("weighted"))


@query(f"WITH {PAIRS} SELECT stream, len(list_filter(reference, lambda x: abs(x * 8) > 1))::INT AS clipped, list_sum(list_transform(reference, lambda x: round_even(greatest(-1.0, least(1.0, x)) * 32767, 0)))::BIGINT AS pcm FROM pairs")
def clip_and_quantize(spark, sf_dir):
    df = pairs(spark, sf_dir).withColumn("loud", F.transform("reference", lambda x: x * 8))
    return df.select("stream", signals.clip_count("loud").alias("clipped"), F.aggregate(signals.pcm16("reference"), F.lit(0).cast("long"), lambda a, x: a + x).alias("pcm"))


@query(f"""WITH {SIGNAL}, g AS (SELECT stream, n, value AS p, 20.0::DOUBLE + n % 5 AS q FROM signal), x AS (SELECT *, greatest(least(p / greatest(q, 1e-12), 1e4) - 1, 0) AS xi FROM g)
SELECT stream, n, round(greatest(0.1, least(1.0, xi / (1 + xi))), 6) AS instantaneous, round(greatest(0.1, least(1.0, sqrt(greatest(p - q, 0.1::DOUBLE * 0.1::DOUBLE * p) / (p + 1e-12)))), 6) AS subtraction, round(p / (p + q + 1e-12), 6) AS oracle FROM x""")
def bin_gains(spark, sf_dir):
    df = signal(spark, sf_dir).withColumn("q", 20.0 + F.col("n") % 5)
    p, q = F.col("value"), F.col("q")
    return df.select("stream", "n", F.round(signals.instantaneous_gain(p, q, 0.1), 6).alias("instantaneous"), F.round(signals.subtraction_gain(p, q, 0.1), 6).alias("subtraction"), F.round(signals.oracle_gain(p, q), 6).alias("oracle"))


@query(f"""WITH {PAIRS}, m AS (SELECT stream, list_transform(reference, lambda x: x - list_avg(reference)) AS r, list_transform(estimate, lambda x: x - list_avg(estimate)) AS e FROM pairs),
k AS (SELECT *, list_dot_product(e, r) / list_dot_product(r, r) AS k, list_dot_product(r, r) AS rr FROM m)
SELECT stream, round(10 * log10((k * k * rr + 1e-12) / (list_sum(list_transform(e, lambda x, i: (x - k * r[i]) * (x - k * r[i]))) + 1e-12)), 6) AS si_sdr_db FROM k""")
def si_sdr(spark, sf_dir):
    return signals.si_sdr(pairs(spark, sf_dir))


@query(f"""WITH {SIGNAL}, p AS (SELECT stream, n::DOUBLE AS x, value AS y FROM signal WHERE n % 4 = 0), a AS (SELECT stream, n + 0.5::DOUBLE AS x FROM signal),
f AS (SELECT a.stream, a.x, (SELECT max({{'x': p.x, 'y': p.y}}) FROM p WHERE p.stream = a.stream AND p.x <= a.x) AS u, (SELECT min({{'x': p.x, 'y': p.y}}) FROM p WHERE p.stream = a.stream AND p.x > a.x) AS v FROM a)
SELECT stream, x, round(CASE WHEN v IS NULL THEN u.y ELSE u.y + (v.y - u.y) * (x - u.x) / (v.x - u.x) END, 6) AS y FROM f""")
def interpolated_activity(spark, sf_dir):
    df = signal(spark, sf_dir)
    points = df.filter("n % 4 = 0").select("stream", F.col("n").cast("double").alias("x"), F.col("value").alias("y"))
    out = signals.interpolate(points, df.select("stream", (F.col("n") + 0.5).alias("x")))
    return out.select("stream", "x", F.round("y", 6).alias("y"))


@query(f"WITH {SIGNAL} SELECT stream, n, round(greatest(0.2, least(1.0, CASE WHEN abs(value) > 1e-12 THEN abs(value - n % 7 / 3.0::DOUBLE) / abs(value) ELSE 1.0 END)), 6) AS gain, round((-0.08::DOUBLE * (value / 97) + 1.2::DOUBLE) * (value / 97) + 0.05::DOUBLE, 6) AS calibrated FROM signal")
def magnitude_and_calibration(spark, sf_dir):
    df, v = signal(spark, sf_dir), F.col("value")
    return df.select("stream", "n", F.round(signals.magnitude_gain(v - F.col("n") % 7 / 3.0, v, 0.2), 6).alias("gain"), F.round(signals.calibrated(v / 97, [-0.08, 1.2, 0.05]), 6).alias("calibrated"))


@query("WITH a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations), b AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place FROM conversations) SELECT a.conv_id, turn, a.place::INT AS place, role AS other FROM a JOIN b ON a.conv_id = b.conv_id AND a.place = b.place")
def positional_zip(spark, sf_dir):
    df = table(spark, sf_dir, "conversations")
    other = df.select("conv_id", (-F.col("turn")).alias("turn"), F.col("role").alias("other"))
    return signals.zip_positions(df.select("conv_id", "turn"), other, "conv_id", "turn", ["other"])


@query("SELECT o_orderkey, printf('%02d:%04.1f', floor(greatest((o_orderkey * 37 - 900) / 10.0::DOUBLE, 0) / 60)::INT, greatest((o_orderkey * 37 - 900) / 10.0::DOUBLE, 0) - floor(greatest((o_orderkey * 37 - 900) / 10.0::DOUBLE, 0) / 60) * 60) AS at FROM orders")
def timestamps(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.timestamp_text((F.col("o_orderkey") * 37 - 900) / 10.0).alias("at"))
