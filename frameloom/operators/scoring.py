"""Scoring and policy: word errors, corpus rates over grouping sets, hypothesis diagnosis, final decisions, detector quality."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import alignment, length_bin, repeated_ngram_fraction, word_distance, words


def score(df: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """``df`` with words, errors, substitutions, deletions and insertions. An empty reference raises; an empty hypothesis is all deletions."""
    df = df.withColumns({"_r": words(reference), "_h": F.coalesce(words(hypothesis), F.array().cast("array<string>"))})
    df = df.withColumn("_a", F.when(F.size("_r") > 0, alignment("_r", "_h")).otherwise(F.raise_error(F.lit("an empty reference")).cast("struct<c:int,s:int,d:int,n:int>")))
    return df.withColumns({"words": F.size("_r"), "errors": F.col("_a.c"), "substitutions": F.col("_a.s"), "deletions": F.col("_a.d"), "insertions": F.col("_a.n")}).drop("_r", "_h", "_a")


def rate(errors: Column, total: Column) -> Column:
    return F.round(F.sum(errors) / F.sum(total), 6)


def error_columns() -> list[Column]:
    sums = [F.sum(c).cast("long").alias(c) for c in ("words", "errors", "substitutions", "deletions", "insertions")]
    return [F.count("*").alias("utterances"), *sums, rate(F.col("errors"), F.col("words")).alias("wer")]


def corpus_rates(scored: DataFrame, condition: str = "condition", baseline: str = "noisy") -> DataFrame:
    """One row for each condition: sums, the corpus rate, and its difference from the baseline's, absolute and relative (null if that is 0)."""
    by = scored.groupBy(condition).agg(*error_columns()).withColumn("_w", F.col("errors") / F.col("words"))
    base = by.filter(F.col(condition) == baseline).select(F.col("_w").alias("_b"))  # one row
    out = by.join(F.broadcast(base), F.lit(True), "left")
    return out.withColumns({"delta": F.round(F.col("_w") - F.col("_b"), 6), "relative_reduction": F.round(F.expr("try_divide(_b - _w, _b)"), 6)}).drop("_b", "_w")


def stratified_rates(scored: DataFrame, strata: list[str], condition: str = "condition") -> DataFrame:
    """(section, stratum, condition, ...): the sums overall and by each stratum column, in one pass over grouping sets. Missing strata are 'unknown'."""
    cells = {f"_{c}": F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in strata}
    df = scored.withColumns(cells).withColumn("_c", F.col(condition))
    sets = [[F.col("_c")], *([F.col(f"_{c}"), F.col("_c")] for c in strata)]
    out = df.groupingSets(sets, *(F.col(f"_{c}") for c in strata), F.col("_c")).agg(*error_columns(), F.grouping_id().alias("_g"))
    section, stratum = F.lit("overall"), F.lit("all")
    for i, c in enumerate(strata):
        here = F.col("_g").bitwiseAND(1 << (len(strata) - i)) == 0
        section, stratum = F.when(here, c).otherwise(section), F.when(here, F.col(f"_{c}")).otherwise(stratum)
    return out.select(section.alias("section"), stratum.alias("stratum"), F.col("_c").alias("condition"), "utterances", "words", "errors", "substitutions", "deletions", "insertions", "wer")


def with_length_bin(scored: DataFrame) -> DataFrame:
    return scored.withColumn("length_bin", length_bin(F.col("words")))


@dataclass(frozen=True)
class Detector:
    compression: float = 2.4
    log_probability: float = -1.0
    ngram: int = 4
    least_words: int = 8
    repeated: float = 0.3
    words_per_second: float = 6.0
    token_limit: int = 224
    token_share: float = 0.95
    no_speech: float = 0.6
    no_speech_words: int = 3
    need_segments: bool = True
    check_times: bool = True
    tolerance: float = 0.2

    def __post_init__(self):
        if min(self.compression, self.ngram, self.least_words, self.words_per_second, self.token_limit, self.no_speech_words) <= 0:
            raise ValueError("thresholds must be positive")
        if not all(0 < x <= 1 for x in (self.repeated, self.token_share, self.no_speech)) or self.tolerance < 0:
            raise ValueError("shares must lie within 0 and 1")


def diagnose(df: DataFrame, c: Detector = Detector(), tokens: str | None = None) -> DataFrame:
    """``df(hypothesis, duration_seconds, segments)`` with reasons, in their order, and anomalous. ``tokens`` names a count, if there is one."""
    numbers = lambda f: F.filter(F.transform("segments", lambda s: s[f]), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    df = df.withColumn("_w", F.coalesce(words("hypothesis"), F.array().cast("array<string>")))
    duration = F.when(F.col("duration_seconds") > 0, F.col("duration_seconds")).otherwise(F.raise_error(F.lit("durations must be positive")).cast("double"))
    df = df.withColumns({"word_count": F.size("_w"), "words_per_second": F.size("_w") / duration, "repeated_fraction": repeated_ngram_fraction("_w", c.ngram)})
    df = df.withColumns({"max_compression": F.array_max(numbers("compression_ratio")), "min_log_probability": F.array_min(numbers("avg_logprob")), "max_no_speech": F.array_max(numbers("no_speech_prob"))})
    bad_time = lambda s: s["start"].isNull() | s["end"].isNull() | (s["start"] < -c.tolerance) | (s["end"] + c.tolerance < s["start"]) | (s["end"] > F.col("duration_seconds") + c.tolerance)
    rules = [
        ("missing_segment_metadata", F.lit(c.need_segments) & (F.coalesce(F.size("segments"), F.lit(0)) <= 0)),
        ("compression_ratio", F.col("max_compression") > c.compression),
        ("low_average_logprob", F.col("min_log_probability") < c.log_probability),
        ("repeated_ngram", (F.col("word_count") >= c.least_words) & (F.col("repeated_fraction") > c.repeated)),
        ("word_rate", F.col("words_per_second") > c.words_per_second),
        ("token_limit", (F.col(tokens) >= F.ceil(F.lit(c.token_limit * c.token_share))) if tokens else F.lit(False)),
        ("no_speech_text_conflict", (F.col("max_no_speech") > c.no_speech) & (F.col("word_count") >= c.no_speech_words)),
        ("invalid_timestamp", F.lit(c.check_times) & F.exists("segments", bad_time)),
    ]
    reasons = F.array_compact(F.array(*(F.when(F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in rules)))
    return df.withColumn("reasons", reasons).withColumn("anomalous", F.size("reasons") > 0).drop("_w")


def compression_anomaly(threshold: float, segments: str = "segments") -> Column:
    """struct(anomalous, count, most): all null without segments; of empty ones false, 0 and null."""
    values = F.transform(segments, lambda s: s["compression_ratio"])
    over = F.size(F.filter(values, lambda x: x > threshold))
    return F.when(F.col(segments).isNotNull(), F.struct((over > 0).alias("anomalous"), over.alias("count"), F.array_max(values).alias("most")))


def decide(df: DataFrame, fallback: list[str], most_distance: float | None = 0.4, abstain: bool = True, baseline: str = "noisy") -> DataFrame:
    """Final status, source and hypothesis of ``df(id, condition, hypothesis, anomalous, retries)``, retries an array of
    struct(hypothesis, anomalous).

    Accept a sound first pass; else the first sound retry, unless it is further than ``most_distance`` from the baseline's final
    text, which then stands in; else that text; else abstain, or keep the unsound first pass. Only ``fallback`` conditions fall back.
    """
    df = df.withColumn("_retry", F.try_element_at(F.filter("retries", lambda a: ~a["anomalous"]), F.lit(1)))
    own = F.when(~F.col("anomalous"), F.struct(F.lit("accepted").alias("status"), F.lit("first_pass").alias("source"), F.col("hypothesis").alias("text")))
    own = own.when(F.col("_retry").isNotNull(), F.struct(F.lit("accepted").alias("status"), F.lit("temperature_retry").alias("source"), F.col("_retry.hypothesis").alias("text")))
    last = F.struct(F.lit("abstained").alias("status"), F.lit("abstained").alias("source"), F.lit(None).cast("string").alias("text")) if abstain else F.struct(F.lit("accepted").alias("status"), F.lit("unsafe_first_pass").alias("source"), F.col("hypothesis").alias("text"))
    df = df.withColumns({"_own": own, "_last": last})
    base = df.filter(F.col("condition") == baseline).select("id", F.coalesce("_own", "_last").alias("_b")).filter("_b.status = 'accepted'")
    df = df.join(base, "id", "left").withColumn("_can", F.col("condition").isin(fallback) & F.col("_b").isNotNull())
    df = df.withColumns({"_x": words("_retry.hypothesis"), "_y": words("_b.text")})
    far = F.lit(False)
    if most_distance is not None:
        distance = F.when(F.col("_can") & (F.col("_own.source") == "temperature_retry"), word_distance(alignment("_x", "_y")["c"], F.col("_x"), F.col("_y")))
        df = df.withColumn("distance", F.round(distance, 6))
        far = F.coalesce(F.col("distance") > most_distance, F.lit(False))
    noisy = F.struct(F.lit("accepted").alias("status"), F.lit("noisy_fallback").alias("source"), F.col("_b.text").alias("text"))
    final = F.when(far, noisy).when(F.col("_own").isNotNull(), F.col("_own")).when(F.col("_can"), noisy).otherwise(F.col("_last"))
    df = df.withColumn("_f", final)
    return df.withColumns({"final_status": F.col("_f.status"), "final_source": F.col("_f.source"), "final_hypothesis": F.col("_f.text")}).drop("_retry", "_own", "_last", "_b", "_can", "_x", "_y", "_f")


def selective(df: DataFrame, by: list[str]) -> DataFrame:
    """Of ``df(errors, words, final_errors)``, the last null where abstained: coverage, the rate over accepted rows, and that over all rows,
    null as soon as one is missing."""
    held = F.col("final_errors").isNotNull()
    accepted = F.count_if(held)
    chosen = F.sum(F.when(held, F.col("final_errors"))) / F.sum(F.when(held, F.col("words")))
    return df.groupBy(*by).agg(
        F.count("*").alias("utterances"), accepted.alias("accepted"), F.round(accepted / F.count("*"), 6).alias("coverage"),
        F.round(chosen, 6).alias("selective_wer"),
        F.round(F.when(accepted == F.count("*"), F.sum("final_errors") / F.sum("words")), 6).alias("full_coverage_wer"),
    )


def confusion(df: DataFrame, truth: Column, guess: Column, by: list[str], empty: float | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, false_alarm and miss rates; ``empty`` stands for a ratio without cases."""
    df = df.withColumns({"_t": truth, "_g": guess})
    out = df.groupBy(*by).agg(
        F.count_if(F.col("_t") & F.col("_g")).alias("tp"), F.count_if(~F.col("_t") & F.col("_g")).alias("fp"),
        F.count_if(F.col("_t") & ~F.col("_g")).alias("fn"), F.count_if(~F.col("_t") & ~F.col("_g")).alias("tn"),
    )
    ratio = lambda a, b: F.round(F.coalesce(F.expr(f"try_divide(cast({a} as double), {b})"), F.lit(empty).cast("double")), 6)
    return out.withColumns({"precision": ratio("tp", "tp + fp"), "recall": ratio("tp", "tp + fn"), "f1": ratio("2 * tp", "2 * tp + fp + fn"), "false_alarm": ratio("fp", "fp + tn"), "miss": ratio("fn", "tp + fn")})
