"""Contracts: each raises ``ContractError`` with examples, and returns its input so that calls can be chained. Nothing is filtered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


class ContractError(ValueError):
    pass


def _raise_if(bad: DataFrame, what: str) -> None:
    rows = bad.limit(5).collect()
    if rows:
        raise ContractError(f"{what}: " + "; ".join(str(r.asDict()) for r in rows))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, or are null or empty, with their number of rows."""
    empty = F.lit(False)
    for k in keys:
        empty = empty | F.col(k).isNull() | (F.col(k).cast("string") == "")
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter((F.col("rows") > 1) | empty)


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    _raise_if(duplicates(df, keys), f"{keys} must be unique and not empty")
    return df


def orphans(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of one side only, with ``side``."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("right")))


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> None:
    _raise_if(orphans(left, right, keys), f"both sides must hold the same {keys}")


def unpaired(df: DataFrame, key: str, condition: str) -> DataFrame:
    """Keys that lack a condition which other keys have, with the number that they have and should have."""
    have = df.groupBy(key).agg(F.countDistinct(condition).alias("conditions"))
    expected = df.agg(F.countDistinct(condition)).first()[0]
    return have.withColumn("expected", F.lit(expected).cast("long")).filter("conditions <> expected")


def paired(df: DataFrame, key: str, condition: str) -> DataFrame:
    _raise_if(unpaired(df, key, condition), f"every {key} must have every {condition}")
    return df


def single_value(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column holds one value, neither null nor empty."""
    found = df.agg(*(F.struct(F.countDistinct(c).alias("n"), F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias("empty")).alias(c) for c in columns)).first()
    bad = [c for c in columns if found[c]["n"] != 1 or found[c]["empty"]]
    if bad:
        raise ContractError(f"{bad} must each hold one value")
    return df


def varying(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys within which a column varies, null counted as a value."""
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.min(c).eqNullSafe(F.max(c)) | ((F.count(c) > 0) & (F.count(c) < F.count("*")))
    return df.groupBy(key).agg(differs.alias("differs")).filter("differs").select(key)


def constant_within(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    _raise_if(varying(df, key, columns), f"{columns} must not vary within a {key}")
    return df


def all_or_none(df: DataFrame, columns: list[str], positive: bool = True) -> DataFrame:
    """The columns are null in all rows or in none; present values are finite and, if asked for, positive."""
    n = df.agg(F.count("*").alias("n"), *(F.count(c).alias(c) for c in columns)).first()
    if {n[c] for c in columns} - {0} and {n[c] for c in columns} != {n["n"]}:
        raise ContractError(f"{columns} must be there in all rows or in none")
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.isnan(c) | (F.abs(c) == float("inf")) | ((F.col(c) <= 0) if positive else F.lit(False))
    _raise_if(df.filter(bad).select(*columns), f"{columns} must be finite" + " and positive" * positive)
    return df


def digest_mismatches(df: DataFrame, text: str, digest: str) -> DataFrame:
    """Rows whose digest isn't the text's SHA-256 in hex; a null text has a null digest."""
    return df.filter(~F.sha2(text, 256).eqNullSafe(F.col(digest)))


def digest_matches(df: DataFrame, text: str, digest: str) -> DataFrame:
    _raise_if(digest_mismatches(df, text, digest).select(text, digest), f"{digest} must be the SHA-256 of {text}")
    return df


def inconsistent_rates(df: DataFrame, rate: str, seconds: str, of: str) -> DataFrame:
    """Rows whose ``rate`` isn't ``seconds`` over ``of`` (see ``close``), or that lack one of them, or whose ``of`` isn't positive."""
    ok = (F.col(of) > 0) & close(F.col(rate), F.try_divide(F.col(seconds), F.col(of)))
    return df.filter(~F.coalesce(ok, F.lit(False)))


def consistent_rates(df: DataFrame, rate: str, seconds: str, of: str) -> DataFrame:
    _raise_if(inconsistent_rates(df, rate, seconds, of).select(rate, seconds, of), f"{rate} must be {seconds} over {of}")
    return df


NUMBERS = ("start", "end", "temperature", "avg_logprob", "compression_ratio", "no_speech_prob")


def segment_fault(segments: str, temperatures: tuple[float, ...] = (0.0,)) -> Column:
    """What is wrong with the first faulty one of an array of recognized segments, null if nothing is: "not a number" (a field of NUMBERS is null, NaN or infinite), "temperature"
    (none of those allowed), "order" (it ends before it starts), "probability" (outside 0 to 1), in this order. An empty or null array has none."""
    bad = " OR ".join(f"s.{f} IS NULL OR isnan(cast(s.{f} AS double)) OR abs(s.{f}) = double('infinity')" for f in NUMBERS)
    allowed = ", ".join(f"{t!r}D" for t in temperatures)
    fault = f"CASE WHEN {bad} THEN 'not a number' WHEN s.temperature NOT IN ({allowed}) THEN 'temperature' WHEN s.end < s.start THEN 'order' WHEN s.no_speech_prob NOT BETWEEN 0 AND 1 THEN 'probability' END"
    return F.expr(f"try_element_at(array_compact(transform({segments}, s -> {fault})), 1)")


def sound_segments(df: DataFrame, key: str, segments: str, temperatures: tuple[float, ...] = (0.0,)) -> DataFrame:
    found = df.select(key, segment_fault(segments, temperatures).alias("fault")).filter("fault is not null")
    _raise_if(found, "segments must be sound")
    return df


def manifest_faults(df: DataFrame) -> DataFrame:
    """(id, problem) of ``df(id, speaker_id, clean, noisy, sample_rate, num_samples, split, noise, snr_db)``, every problem of every row: "missing <field>" (null), "unsafe id" (empty, a dot path, or with a
    slash), "speaker" (not the id up to its first _), "<side> name" (the file's name without its ending isn't the id), and once for each id that occurs more than once "duplicate"."""
    fields = ("id", "speaker_id", "split", "noise", "snr_db", "clean", "noisy", "sample_rate", "num_samples")
    missing = [F.when(F.col(c).isNull(), f"missing {c}") for c in fields]
    unsafe = (F.col("id") == "") | F.col("id").isin(".", "..") | F.contains("id", F.lit("/"))
    stem = lambda c: F.regexp_replace(F.substring_index(c, "/", -1), r"(.)\.[^.]*$", "$1")
    checks = [*missing, F.when(unsafe, "unsafe id"), F.when(F.substring_index("id", "_", 1) != F.col("speaker_id"), "speaker"), *(F.when(stem(c) != F.col("id"), f"{c} name") for c in ("clean", "noisy"))]
    found = df.select("id", F.explode(F.array_compact(F.array(*checks))).alias("problem"))
    return found.unionByName(df.filter("id is not null").groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id", F.lit("duplicate").alias("problem")))


def safe_manifest(df: DataFrame) -> DataFrame:
    """The manifest has rows, and none of the faults."""
    if df.isEmpty():
        raise ContractError("the manifest is empty")
    _raise_if(manifest_faults(df), "the manifest's rows must be safe")
    return df


def reserved_fields(df: DataFrame, row: str, reserved: set[str]) -> DataFrame:
    """``df`` with field: each of the ``reserved`` names that the JSON object in ``row`` has at its top level."""
    names = F.array(*map(F.lit, sorted(reserved)))
    return df.withColumn("field", F.explode(F.array_intersect(F.json_object_keys(row), names)))


def without(df: DataFrame, reserved: set[str]) -> DataFrame:
    if found := reserved & set(df.columns):
        raise ContractError(f"reserved columns: {sorted(found)}")
    return df


def others(df: DataFrame, column: str, allowed: set) -> DataFrame:
    """Rows with another value than the allowed ones, or none."""
    return df.filter(~F.coalesce(F.col(column).isin(sorted(allowed)), F.lit(False)))


def only(df: DataFrame, column: str, allowed: set) -> DataFrame:
    _raise_if(others(df, column, allowed).select(column), f"{column} must be one of {sorted(allowed)}")
    return df


def partial_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rows, present, faulty): of each column, how many rows have it, and in how many it isn't finite and positive."""
    counts = [F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.count(c).alias("present"), F.count_if(F.isnan(c) | (F.abs(c) == float("inf")) | (F.col(c) <= 0)).alias("faulty")) for c in columns]
    return df.agg(F.array(*counts).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def finite(samples: str | Column) -> Column:
    """An assertion to select or filter by: the array is there, and all its values are finite."""
    ok = F.forall(samples, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.assert_true(F.coalesce(ok, F.lit(False)), "samples must be finite")


def close(a: Column, b: Column, relative: float = 1e-6, absolute: float = 1e-9) -> Column:
    return F.abs(a - b) <= F.greatest(relative * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def frozen(settings: dict, protocol: dict, path: str = "") -> dict:
    """``settings`` where each value of ``protocol`` stands at its place, nested ones too; raises with all places that differ. Numbers are compared as
    numbers, true and 1 are different; settings beyond the protocol are free."""
    bad = list(_differing(settings, protocol, path))
    if bad:
        raise ContractError("not the frozen protocol: " + "; ".join(bad))
    return settings


def _differing(have, want, path: str):
    if isinstance(want, dict):
        if not isinstance(have, dict):
            yield f"{path or '.'} must be a group"
            return
        for k, v in want.items():
            at = f"{path}.{k}".lstrip(".")
            if k not in have:
                yield f"{at} is missing"
            else:
                yield from _differing(have[k], v, at)
    elif isinstance(have, bool) != isinstance(want, bool) or have != want:
        yield f"{path} is {have!r}, not {want!r}"


def frozen_experiment(df: DataFrame, key: str, condition: str, conditions: set[str], identities: list[str], metadata: list[str], fixed: dict) -> DataFrame:
    """``df`` where each key has all ``conditions`` once and no other, the columns ``identities`` hold one value each, ``metadata`` doesn't vary within a
    key, and the columns of ``fixed`` hold its values."""
    found = {r[0] for r in df.select(condition).distinct().limit(len(conditions) + 1).collect()}
    if found != conditions:
        raise ContractError(f"conditions are {sorted(map(str, found))}, not {sorted(conditions)}")
    constant_within(single_value(paired(unique(df, [key, condition]), key, condition), identities), key, metadata)
    differs = F.lit(False)
    for c, v in fixed.items():
        differs = differs | ~F.col(c).eqNullSafe(F.lit(v))
    _raise_if(df.filter(differs).select(key, condition, *fixed), f"the columns must hold {fixed}")
    return df
