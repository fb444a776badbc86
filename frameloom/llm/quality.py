"""Quality classifier: an interpolated modified Kneser-Ney model over bytes, trained on trusted text.

Training text is the whole text of all rows labelled good but every ``APART``th by hash. Counts of the n-grams of ``ORDER`` bytes,
continuation counts of the shorter ones, discounts and context totals are grouped and joined on the n-gram, dealt over the cluster by
its hash. The model grows with the training text and is held in no process: it lies in the shared folder as shards of some ``SHARD``
rows. A scoring task gathers the distinct n-grams of some ``HELD`` bytes of text and joins those it hasn't met yet with the shards, one at a
time. A corpus-wide exchange of (document, n-gram) rows instead would write some 10 times the input to disk.

A document's perplexity is per byte, over its whole text. Thresholds are the ``QUANTILE`` of perplexities of the good rows that were kept
apart, which the model hasn't seen, by language and by size, as the first bytes of a text cost more than later ones: one for each
language and class of ``SIZES``; with fewer than ``LEAST`` such rows, that of the class over all languages, then of the language, then of all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import store
from .kernels import U64, HashTable, text_chunks
from .skew import look_up

ORDER = 5
PIECE = 1 << 18  # bytes whose n-grams are made at once
SHARD = 1 << 18  # rows
HELD = 1 << 24  # bytes of text
MET = 1 << 20  # n-grams whose probabilities a worker keeps from batch to batch
READY = 1 << 21  # rows of shards that a worker keeps
QUANTILE = 0.995
APART = 5
SIZES = (100, 400, 2000)  # bytes from which the next class begins
LEAST = 30


def ngrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte the code of it and the ORDER - 1 before it, zeros before a text's start; the newest byte is lowest."""
    n = np.diff(offsets)
    at = np.arange(len(data)) + np.repeat(np.arange(1, len(n) + 1) * (ORDER - 1), n)
    padded = np.zeros(len(data) + (ORDER - 1) * (len(n) + 1), np.uint64)
    padded[at] = data
    code = padded[at]
    for k in range(1, ORDER):
        code |= padded[at - k] << U64(8 * k)
    return code


def gram_chunks(texts: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, codes of its n-grams and of those of rows after it, offsets); a long text comes in several parts of one row."""
    for a, _, data, offsets in text_chunks(texts, size):
        if len(data) <= size:
            yield a, ngrams(data, offsets), offsets
            continue
        for i in range(0, len(data), size):
            lead = min(i, ORDER - 1)
            part = data[i - lead : i + size]
            yield a, ngrams(part, np.array([0, len(part)]))[lead:], np.array([0, len(part) - lead])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, codes, _ in gram_chunks(batch.column(0), 1 << 20):
            codes, n = np.unique(codes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(n, pa.int64())], ["code", "n"])


def train(trusted: DataFrame) -> list[str]:
    """The model of ``trusted(text)``, as the URIs of its shards: (level, code, value), sorted. On level k, from 1 on, are the log
    probabilities of seen n-grams of k bytes, on level -k the log weights of their contexts' lower orders. An empty table gives a
    model in which all bytes are equally likely."""
    counts = store.materialize(trusted.select("text").mapInArrow(_count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "ngrams")
    tables = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        suffix = F.col("code").bitwiseAND(F.lit((1 << 8 * k) - 1))
        tables[k] = tables[k + 1].groupBy(suffix.alias("code")).agg(F.count("*").alias("n"))
    few = {k: t.filter("n <= 4").groupBy("n").count() for k, t in tables.items()}
    rows = None
    for k, t in few.items():
        t = t.select(F.lit(k).alias("k"), "n", "count")
        rows = t if rows is None else rows.unionByName(t)
    seen = {(r["k"], r["n"]): r["count"] for r in rows.collect()}
    below = None
    out = None
    for k in range(1, ORDER + 1):
        d1, d2, d3 = discounts(*(seen.get((k, i), 0) for i in (1, 2, 3, 4)))
        n = F.col("n")
        cut = F.when(n == 1, d1).when(n == 2, d2).otherwise(d3)
        t = tables[k].withColumn("context", F.shiftright("code", 8))
        totals = t.groupBy("context").agg(F.sum("n").alias("total"), F.sum(cut).alias("cut"))
        t = t.join(totals, "context").withColumn("weight", F.col("cut") / F.col("total"))
        lower = F.lit(1 / 256)
        if below is not None:
            t = t.withColumn("suffix", F.col("code").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))).join(below, "suffix")
            lower = F.col("lower")
        t = t.withColumn("p", (n - cut) / F.col("total") + F.col("weight") * lower)
        t = store.materialize(t.select(F.lit(k).alias("k"), "code", "context", "p", "weight"), "order")
        value = lambda c: F.log(c).cast("float").alias("value")
        grams = t.select("k", "code", value(F.col("p")))
        contexts = t.groupBy((-F.col("k")).alias("k"), F.col("context").alias("code")).agg(value(F.greatest(F.first("weight"), F.lit(1e-12))))
        out = grams.unionByName(contexts) if out is None else out.unionByName(grams).unionByName(contexts)
        below = t.select(F.col("code").alias("suffix"), F.col("p").alias("lower"))
    out = store.materialize(out.select(F.col("k").cast("int").alias("level"), "code", "value"), "levels")
    shards = out.coalesce(max(1, math.ceil(out.count() / SHARD))).sortWithinPartitions("level", "code")
    return store.materialize(shards, "model").inputFiles()


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts of Chen and Goodman; where counts are too few for them, 0.5, 0.75 and 0.9."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(i - (i + 1) * y * b / a, 0.05), i - 0.05) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _shard(uri: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By level, the codes, ascending, and their values."""
    fs, path = store.open_fs(uri)
    table = pq.read_table(path, filesystem=fs)
    level, code, value = (table.column(c).to_numpy() for c in ("level", "code", "value"))
    levels, first = np.unique(level, return_index=True)
    return {int(k): (code[a:b].view(np.uint64), value[a:b]) for k, a, b in zip(levels, first, [*first[1:], len(level)])}


class Scorer:
    """Log probabilities by the model in ``shards``. Codes get numbers as they are met; those not met before are settled together."""

    def __init__(self, shards: list[str]):
        self.shards = shards
        self.ready: dict[str, dict] = {}
        self.room = READY
        self._fresh()

    def _fresh(self) -> None:
        self.table, self.values, self.open = HashTable(16), np.zeros(0, np.float32), []

    def _read(self) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
        for uri in self.shards:
            shard = self.ready.get(uri)
            if shard is None:
                shard = _shard(uri)
                rows = sum(len(codes) for codes, _ in shard.values())
                if rows <= self.room:
                    self.ready[uri] = shard
                    self.room -= rows
            yield shard

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        found = self.table.find(codes)
        new = found < 0
        if new.any():
            some = np.unique(codes[new])
            self.table.add(some, np.arange(self.table.n, self.table.n + len(some), dtype=np.int32))
            self.open.append(some)
            found[new] = self.table.find(codes[new])
        return found

    def settle(self) -> None:
        if self.open:
            codes = np.concatenate(self.open)
            self.open = []
            self.values = np.concatenate([self.values, *(self._join(codes[i : i + (1 << 20)]) for i in range(0, len(codes), 1 << 20))])

    def _join(self, codes: np.ndarray) -> np.ndarray:
        """One pass over the shards for all orders of the n-grams."""
        keys, back, values = {}, {}, {}
        for k in range(1, ORDER + 1):
            suffix = codes & U64((1 << 8 * k) - 1)
            for level, x in ((k, suffix), (-k, suffix >> U64(8))):
                keys[level], back[level] = np.unique(x, return_inverse=True)
                back[level] = back[level].astype(np.int32)
                values[level] = np.full(len(keys[level]), np.nan, np.float32)
        for shard in self._read():
            for level, (have, value) in shard.items():
                want = keys[level]
                if len(want) < len(have):
                    at = np.searchsorted(have, want).clip(0, len(have) - 1)
                    hit = have[at] == want
                    values[level][hit] = value[at[hit]]
                else:
                    at = np.searchsorted(want, have).clip(0, len(want) - 1)
                    hit = want[at] == have
                    values[level][at[hit]] = value[hit]
        out = np.full(len(codes), math.log(1 / 256))
        for k in range(1, ORDER + 1):
            seen = values[k][back[k]]
            out = np.where(np.isnan(seen), out + np.nan_to_num(values[-k][back[-k]], nan=0.0), seen)
        return out.astype(np.float32)

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        found = self.numbers(codes)
        self.settle()
        return self.values[found].astype(float)

    def perplexities(self, columns: list[pa.Array]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each column of texts (bytes, perplexity per byte, NaN without text)."""
        if self.table.n > MET:
            self._fresh()
        parts = [[(a, self.numbers(codes), offsets) for a, codes, offsets in gram_chunks(texts, PIECE)] for texts in columns]
        self.settle()
        out = []
        for texts, some in zip(columns, parts):
            n, s = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            for a, found, offsets in some:
                size = np.diff(offsets)
                full = size > 0
                rows = a + np.flatnonzero(full)
                n[rows] += size[full]
                if len(rows):
                    s[rows] += np.add.reduceat(self.values[found].astype(float), offsets[:-1][full])
            out.append((n, np.where(n > 0, np.exp(-s / np.maximum(n, 1)), np.nan)))
        return out


def _scorer(shards: list[str]) -> Scorer:
    """One for each worker process and model."""
    if _scorers.get("of") != shards:
        _scorers.update(of=shards, scorer=Scorer(shards))
    return _scorers["scorer"]


_scorers: dict = {}


def score(documents: DataFrame, labels: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (default doc_id and lang) with n_bytes and perplexity (null without text), written to the shared folder."""
    spark = documents.sparkSession
    store.small_batches(spark)
    good = good_rows(labels).filter(~apart())
    # texts are dealt out by doc_id at all sizes: the list of trusted rows grows with the input
    shards = train(documents.select("doc_id", "text").filter("doc_id is not null and text <> ''").join(good.hint("shuffle_hash"), "doc_id", "left_semi"))
    carry = carry or ["doc_id", "lang"]
    kinds = {f.name: f for f in documents.schema.fields}
    source = documents.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(carry)), *([] if "text" in carry else [F.col("text").alias("_text")]))
    text = f"_{carry.index('text')}" if "text" in carry else "_text"

    def scored_rows(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, (n, p) in zip(held, _scorer(shards).perplexities([batch.column(text) for batch in held])):
            columns = [batch.column(i) for i in range(len(carry))] + [pa.array(n, pa.int64()), pa.array(np.round(p, 4), from_pandas=True)]
            yield pa.RecordBatch.from_arrays(columns, [*(f"_{i}" for i in range(len(carry))), "n_bytes", "perplexity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(text).nbytes
            if size >= HELD:
                yield from scored_rows(held)
                held, size = [], 0
        yield from scored_rows(held)

    shape = ", ".join(f"_{i} {kinds[c].dataType.simpleString()}" for i, c in enumerate(carry)) + ", n_bytes long, perplexity double"
    scored = source.mapInArrow(run, shape)
    return store.materialize(scored.toDF(*carry, "n_bytes", "perplexity"), "perplexities")


def good_rows(labels: DataFrame) -> DataFrame:
    """The doc_ids with a row that says quality 1, each once."""
    return labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()


def apart() -> Column:
    """Whether the row is kept from training."""
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit("apart")), F.lit(APART)) == 0


def size_class(n_bytes: str = "n_bytes") -> Column:
    out = F.lit(0)
    for least in SIZES:
        out = out + (F.col(n_bytes) >= least).cast("int")
    return out


def judge(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """``scored`` with threshold and kept: text at or below its threshold. Null is a language like any other. Without any good rows kept apart
    all text is kept; documents without text never are."""
    good = good_rows(labels).filter(apart())
    trusted = scored.select("doc_id", "lang", "perplexity", size_class().alias("class")).filter("perplexity is not null").join(good, "doc_id", "left_semi")
    q = F.percentile_approx("perplexity", F.lit(QUANTILE), F.lit(10000)).alias("q")
    by = trusted.cube("lang", "class").agg(q, F.count("*").alias("n"), F.grouping_id().alias("over")).filter((F.col("n") >= LEAST) | (F.col("over") == 3))
    by = store.materialize(by, "thresholds")
    # bits of over: 2 for all languages, 1 for all classes
    own = by.filter("over = 0").select(F.col("lang").alias("_lang"), F.col("class").alias("_class"), F.col("q").alias("_own"))
    lang = by.filter("over = 1").select(F.col("lang").alias("_lang"), F.col("q").alias("_of_lang"))
    sized = {r["class"]: r["q"] for r in by.filter("over = 2").collect()}  # a row for each class
    every = by.filter("over = 3").agg(F.max("q")).first()[0]
    of_class = F.lit(None).cast("double")
    for k, v in sized.items():
        of_class = F.when(F.col("_size") == k, v).otherwise(of_class)
    out = scored.withColumn("_size", size_class())
    out = look_up(out, own, {"lang": "_lang", "_size": "_class"}, ["n_bytes", "perplexity"], own.count())
    out = look_up(out, lang, {"lang": "_lang"}, ["n_bytes", "perplexity"], lang.count())
    out = out.withColumn("threshold", F.coalesce("_own", of_class, "_of_lang", F.lit(every).cast("double"), F.lit(float("inf")))).drop("_own", "_of_lang", "_size")
    return out.withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
    return judge(scored, labels).select("doc_id", "lang", "n_bytes", "perplexity", "threshold", "kept")


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` that the classifier keeps, all columns unchanged."""
    names = [c if c in ("doc_id", "lang", "text") else f"_{i}_{c}" for i, c in enumerate(documents.columns)]
    renamed = documents.toDF(*names)
    return judge(score(renamed, labels, names), labels).filter("kept").select(*names).toDF(*documents.columns)
