"""URL filter: a list of host and path rules, and beyond it association rules mined from labels.

Host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path what follows up to ``?``, ``#`` or
the end. A list rule fits its host and all subdomains where the path starts with the rule's; the longest wins.

For mining, a URL is a set of tokens of which none implies another: its scheme, the host's last two labels, each label before them by
its place, the path's segments without digits and the names of its parameters. A URL's label is that of the document whose number
ends its path: block if of poor quality or toxic. Spark's FP-growth mines tokens with verdicts in all distinct labelled URLs. A rule
needs a share ``SUPPORT`` of them and ``LEAST`` URLs, more hits than misses (``CONFIDENCE``), and ``LIFT`` times its verdict's share of
all labelled URLs; it falls if a shorter one for the same verdict is as sure. Of the rules that fit a URL the strongest decides: the
one whose hits exceed what its verdict's share lets expect by most standard deviations. Rules are found by an inverted index from
each one's rarest token. Where none fits, the verdict is the one that most labelled URLs have (allow, if there are none).
"""

from __future__ import annotations

import math
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import skew, store

SUPPORT, LEAST, CONFIDENCE = 0.001, 5, 0.5
LIFT = {"block": 1.5, "allow": 1.1}
LONGEST = 4  # tokens of a mined rule, verdict included
BLOCK, ALLOW = "=block", "=allow"
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: str = "url") -> tuple[Column, Column]:
    """(host, path) as columns, empty for null and where there is no ``://``."""
    after = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    return lower(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)


def listed(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest list rule that fits, null if none does; of equally long ones the first."""
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in reversed(sorted(rules, key=lambda r: -len(r[1] + r[2]))):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def tokens(df: DataFrame) -> DataFrame:
    """``df(url, host, path)`` with tokens, an array of distinct strings."""
    labels = F.filter(F.reverse(F.split("host", r"\.")), lambda x: x != "")
    df = df.withColumn("_labels", labels)
    domain = F.when(F.size("_labels") > 0, F.array(F.concat(F.lit("d:"), F.array_join(F.reverse(F.slice("_labels", 1, 2)), ".")))).otherwise(F.array().cast("array<string>"))
    before = F.transform(F.slice("_labels", 3, 1 << 20), lambda x, i: F.concat(F.lit("l"), i.cast("string"), F.lit(":"), x))
    segments = F.transform(F.filter(F.split("path", "/"), lambda x: (x != "") & ~x.rlike(r"[0-9]")), lambda x: F.concat(F.lit("p:"), x))
    query = F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    scheme = F.array(F.concat(F.lit("s:"), F.substring_index(F.coalesce("url", F.lit("")), "://", 1)))
    scheme = F.when(F.instr("url", "://") > 0, scheme).otherwise(F.array().cast("array<string>"))
    return df.withColumn("tokens", F.array_distinct(F.concat(scheme, domain, before, segments, names))).drop("_labels")


class Mined(NamedTuple):
    tokens: list[str]
    verdict: str
    confidence: float
    support: float  # share of the labelled URLs that hold the tokens and have the verdict
    strength: float


def mine(labelled: DataFrame) -> tuple[list[Mined], str]:
    """(the rules in ``labelled(tokens, verdict)``, strongest first; the most frequent verdict). Ties of strength go by confidence, support, block
    before allow, then tokens; a tie of verdicts is allow. No rules in an empty table.

    Tokens that stand in the same URLs (as parameters of one campaign do) are mined as one and written out in the rules. Tokens that stand together often but not always are not: mining takes time that
    may double with each of them. A rule of at most LONGEST tokens stands for a share SUPPORT of the URLs at least, which bounds their number at all sizes: with t tokens in a URL
    there are at most 1 / SUPPORT times t ** (LONGEST - 1) of them on the driver.
    """
    from pyspark.ml.fpm import FPGrowth

    spark = labelled.sparkSession
    rows = store.materialize(labelled.select(F.concat("tokens", F.array(F.concat(F.lit("="), "verdict"))).alias("items")), "labelled")
    n = rows.count()
    if not n:
        return [], "allow"
    support = max(SUPPORT, LEAST / n)
    # tokens below the support can't be part of a rule; tokens of the same rows are one item, as every set of them would be mined
    place = F.xxhash64(F.monotonically_increasing_id()).cast("decimal(38,0)")
    items = rows.withColumn("place", place).select("place", F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("count"), F.sum("place").alias("places"))
    often, alike = {}, {}
    for r in items.filter((F.col("count") >= support * n) | F.col("item").isin(BLOCK, ALLOW)).collect():
        often[r["item"]] = r["count"]
        if r["count"] >= support * n:
            alike.setdefault((r["count"], r["places"], r["item"] in (BLOCK, ALLOW)), []).append(r["item"])
    members = {min(v): sorted(v) for v in alike.values()}
    share = {v: often.get(f"={v}", 0) / n for v in LIFT}
    rows = rows.select(F.array_intersect("items", F.array(*map(F.lit, sorted(members))).cast("array<string>")).alias("items"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=CONFIDENCE, numPartitions=parts).fit(rows.repartition(parts))
    found = model.associationRules.filter(F.col("consequent")[0].isin(BLOCK, ALLOW) & (F.size("antecedent") < LONGEST))
    rules = []
    for r in found.collect():
        verdict, held = r["consequent"][0][1:], r["support"] / r["confidence"] * n
        base = share[verdict]
        if r["confidence"] > CONFIDENCE and r["confidence"] >= LIFT[verdict] * base:
            strength = (r["confidence"] - base) / math.sqrt(base * (1 - base) / held) if base < 1 else 0.0
            for tokens in product(*(members[x] for x in r["antecedent"])):
                rules.append(Mined(sorted(tokens), verdict, r["confidence"], r["support"], strength))
    kept: list[Mined] = []
    for rule in sorted(rules, key=lambda r: (len(r.tokens), -r.confidence, r.tokens)):
        if not any(k.verdict == rule.verdict and k.confidence >= rule.confidence and set(k.tokens) <= set(rule.tokens) for k in kept):
            kept.append(rule)
    kept.sort(key=lambda r: (-round(r.strength, 9), -r.confidence, -r.support, r.verdict != "block", r.tokens))
    return kept, "block" if share["block"] > share["allow"] else "allow"


MINED = "struct<i:int, verdict:string, tokens:array<string>, rule:string, confidence:double, support:double>"


def matched(df: DataFrame, rules: list[Mined]) -> DataFrame:
    """``df(tokens, ...)`` with _mined: the strongest rule whose tokens are all there, null if there is none."""
    if not rules:
        return df.withColumn("_mined", F.lit(None).cast(MINED))
    often: dict[str, int] = {}
    for r in rules:
        for x in r.tokens:
            often[x] = often.get(x, 0) + 1
    index: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        index.setdefault(min(r.tokens, key=lambda x: (often[x], x)), []).append(i)

    def entry(i: int) -> Column:
        r = rules[i]
        return F.struct(F.lit(i), F.lit(r.verdict), F.array(*map(F.lit, r.tokens)), F.lit(" & ".join(r.tokens)), F.lit(r.confidence), F.lit(r.support)).cast(MINED)

    lookup = F.create_map(*(x for k, v in index.items() for x in (F.lit(k), F.array(*map(entry, v)))))
    posted = F.flatten(F.transform(F.filter("tokens", lambda t: t.isin(list(index))), lambda t: F.element_at(lookup, t)))
    fits = F.filter(posted, lambda r: F.size(F.array_except(r["tokens"], F.col("tokens"))) == 0)
    return df.withColumn("_mined", F.array_min(fits))


def labelled_urls(urls: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, host, path, verdict) of the distinct rows of ``urls(url, host, path)`` whose document has a label. A document with several label rows is
    bad if one of them says so; nulls in quality or toxic say nothing bad."""
    number = F.expr("try_cast(regexp_extract(path, '([0-9]+)[^0-9/]*/?$', 1) as bigint)")
    distinct = urls.select("url", "host", "path").filter("url is not null").distinct().withColumn("doc_id", number).filter("doc_id is not null")
    bad = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    # many URLs may end in one number; labels are met by exchange, as their table may be large
    rows = store.materialize(distinct, "numbered")
    counts = rows.groupBy("doc_id").agg(F.count("*").alias("n"))
    joined = skew.meet(rows, bad.join(counts.hint("merge"), "doc_id").hint("merge"), ["doc_id"], rows.count())
    return joined.select("url", "host", "path", F.when(F.col("bad") == 1, "block").otherwise("allow").alias("verdict"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule (of the list) and verdict: the rule's, else that of the strongest mined rule, else the most frequent one.
    mined_rule, confidence and support are those of the mined rule where it decides, else null.

    Columns of ``pages`` other than url are returned as they are, unless their names clash with these. Null urls and urls without host get what has
    no tokens gets; repeated rows get equal results; empty tables give empty ones."""
    host, path = parts()
    names = ("host", "path", "rule", "verdict", "mined_rule", "confidence", "support", "tokens")
    df = pages.select(*(c for c in pages.columns if c not in names)).withColumns({"host": host, "path": path})
    mined, usual = mine(tokens(labelled_urls(df, labels)).select("tokens", "verdict"))
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    df = matched(tokens(df), mined).withColumns({"rule": rule, "_listed": verdict})
    decides = F.when(F.col("_listed").isNull(), F.col("_mined"))
    df = df.withColumns({"mined_rule": decides["rule"], "confidence": decides["confidence"], "support": decides["support"]})
    return df.withColumn("verdict", F.coalesce("_listed", F.col("_mined.verdict"), F.lit(usual))).drop("_listed", "_mined", "tokens")


def assess(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(mined, label, n): mined on the labelled URLs of ``pages(url)`` outside every fifth by hash, tried on that fifth; mined is the verdict of the
    strongest rule, or none."""
    host, path = parts()
    known = labelled_urls(pages.select("url").withColumns({"host": host, "path": path}), labels)
    apart = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    rules, _ = mine(tokens(known.filter(~apart)).select("tokens", "verdict"))
    tried = matched(tokens(known.filter(apart)), rules)
    return tried.groupBy(F.coalesce("_mined.verdict", F.lit("none")).alias("mined"), F.col("verdict").alias("label")).agg(F.count("*").alias("n"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    out = filter_urls(pages, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("page_id", "host", "path", "rule", "verdict", "mined_rule", "confidence", "support")
