"""Mixing sources to target weights by balanced sampling with the cube method.

A source of ``source_size`` words and target T is taken at the rate r = T / source_size: each document floor(r) times, and once
more with the chance r - floor(r). Which documents get the extra copy is drawn by the cube method (Deville and Tille, 2004):
flight moves the chances along vectors that leave the balancing totals (documents and words) unchanged until each is 0 or 1.

Flight is done in cells of some ``CELL`` documents of one source, dealt by the hash of doc_id and size, largest documents first; a
cell leaves at most two undecided. The undecided of ``CELL`` cells meet in a cell of the next level, so the levels' number grows
with the logarithm of the documents, no task holds more than a few cells, and hot sources are just more cells. One cell of each
source is kept back for the last level. There the last two undecided land: of their four outcomes the one nearest to the words that
remain of the target is taken. As an undecided document may be a long one, what is still missing is then made up with decided
documents of this cell, by exchanging one for another where that suffices. Draws depend on ids and sizes only, so reruns agree.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import store
from .skew import look_up

CELL = 1024
EXCHANGES = 64
MOST = 3.0
WEIGHTS = (5, 2, 1)
SEED = 20260724
EPS = 1e-9


def level_of(caps: DataFrame, total: float) -> float:
    """The number of words u for each unit of weight, such that shares ``least(u * weight, cap)`` of ``caps(weight, cap)`` sum to ``total``: what is
    above a cap is shared anew by weight among the others until none is above. Only sums come to the driver. Infinite where all caps are too low."""
    unit = 0.0
    while True:
        full = F.col("cap") < F.col("weight") * unit
        r = caps.agg(F.sum(F.when(full, F.col("cap"))).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        now = (total - float(r["held"] or 0)) / r["open"] if r["open"] else float("inf")
        if now <= unit or now == float("inf"):
            return now if r["open"] is None else unit
        unit = now


def numbered(totals: DataFrame) -> DataFrame:
    """``totals`` with number, its rows' place (from 0) in the code point order of source, null last: sorted in ranges, whose sizes are summed."""
    key = F.struct(F.col("source").isNull().alias("last"), F.col("source"))
    placed = totals.withColumn("_key", key).repartitionByRange("_key").sortWithinPartitions("_key").drop("_key").withColumn("_id", F.monotonically_increasing_id())
    placed = store.materialize(placed.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))), "sources")
    counts = {r["_part"]: r["count"] for r in placed.groupBy("_part").count().collect()}  # a row for each range
    before, pairs = 0, []
    for part in sorted(counts):
        pairs += [F.lit(part), F.lit(before)]
        before += counts[part]
    lead = F.element_at(F.create_map(*pairs), F.col("_part")) if pairs else F.lit(0)
    return placed.withColumn("number", (lead + F.col("_at")).cast("long")).drop("_id", "_part", "_at")


def fly(p: np.ndarray, size: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """The flight phase for totals of documents and words: returns chances of which at most two are not 0 or 1."""
    p = p.copy()
    held: list[int] = []
    for i in range(len(p) + 1):
        while len(held) == 3:
            a, b, c = held
            u = np.array([size[b] - size[c], size[c] - size[a], size[a] - size[b]], float)  # sum 0, and sum with sizes 0
            if not u.any():
                u = np.array([1.0, -1.0, 0.0])
            x = p[held]
            up, down = _reach(x, u), _reach(x, -u)
            x = x + up * u if draw.random() * (up + down) < down else x - down * u
            x[x < EPS], x[x > 1 - EPS] = 0.0, 1.0
            p[held] = x
            held = [k for k, v in zip(held, x) if 0 < v < 1]
        if i < len(p) and 0 < p[i] < 1:
            held.append(i)
    return p


def _reach(x: np.ndarray, u: np.ndarray) -> float:
    """How far x may move along u within 0 and 1."""
    with np.errstate(divide="ignore"):
        return float(np.min(np.where(u > 0, (1 - x) / np.where(u > 0, u, 1), np.where(u < 0, x / np.where(u < 0, -u, 1), np.inf))))


def land(p: np.ndarray, size: np.ndarray, want: float) -> np.ndarray:
    """Decided chances whose words come near ``want``. Each outcome of the undecided (few) is tried, and then made nearer by exchanging taken and left
    documents, one for one, so that the documents' total stays; before that, as another try, by taking or leaving long ones before short ones
    where that doesn't overshoot. The try that ends nearest wins, in whole words, of equally near ones that with the fewest changes."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    best, out = (np.inf, 0), p
    for outcome in np.arange(1 << len(open_))[:, None] >> np.arange(len(open_)) & 1:
        for filled in (False, True):
            q = p.copy()
            q[open_] = outcome
            changes = _fill(q, size, want) if filled else 0
            changes += _exchange(q, size, want)
            rank = (round(abs(want - float(size @ q))), changes)
            if rank < best:
                best, out = rank, q
    return out


def _exchange(p: np.ndarray, size: np.ndarray, want: float) -> int:
    """Exchanges in place a taken for a left document, the pair that comes nearest to ``want`` first, while that helps; returns their number."""
    for n in range(EXCHANGES):
        missing = want - float(size @ p)
        taken, left = np.flatnonzero(p == 1), np.flatnonzero(p == 0)
        if not len(taken) or not len(left):
            return n
        left = left[np.argsort(size[left], kind="stable")]
        above = np.searchsorted(size[left], size[taken] + missing)
        pairs = [(np.abs(missing + size[taken] - size[left[at]]), at) for at in (above.clip(0, len(left) - 1), (above - 1).clip(0, len(left) - 1))]
        rest, at = min(pairs, key=lambda x: x[0].min())
        k = int(np.argmin(rest))
        if rest[k] > abs(missing) - EPS:
            return n
        p[[taken[k], left[at[k]]]] = 0.0, 1.0
    return EXCHANGES


def _fill(p: np.ndarray, size: np.ndarray, want: float) -> int:
    """Takes left documents (or leaves taken ones, if there are too many words) in place, long ones first, none beyond ``want``; returns their number."""
    missing = want - float(size @ p)
    can = np.flatnonzero((p == 0) if missing > 0 else (p == 1))
    rest, n = abs(missing), 0
    for i in can[np.argsort(-size[can], kind="stable")]:
        if 0 < size[i] <= rest:
            p[i] = 1 - p[i]
            rest, n = rest - size[i], n + 1
    return n


def _level(last: bool, level: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        weight = t.column("weight").to_numpy()
        order = np.lexsort((t.column("size").to_numpy(), t.column("unit").to_numpy(), -weight))
        t, weight = t.take(pa.array(order)), weight[order].astype(float)
        source, cell = (k.as_py() for k in key)
        before = t.column("p").to_numpy()
        p = fly(before, weight, np.random.default_rng([SEED, level, source, cell]))
        if last:
            p = land(p, weight, float(before @ weight))
        return t.select(["unit", "source", "size", "weight"]).append_column("p", pa.array(p))

    return run


def word_count(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix(sized: DataFrame, tag: str = "mix", target: float | None = None) -> DataFrame:
    """``sized(unit, source, size)`` with source_size, target and taken (columns of these names are replaced, all others kept).

    ``unit`` names the row. Rows of one unit, source and size are drawn together and get equal copies. Null is a source of its own, the
    last. Documents without words are taken 0 words; an empty table gives an empty one.
    """
    sized = sized.drop("source_size", "target", "taken")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("number") % len(WEIGHTS) + 1).cast("int"))
    totals = store.materialize(numbered(totals).withColumn("weight", weight).withColumn("cap", MOST * F.col("source_size")), "sources")
    total = totals.agg(F.sum("source_size").alias("s"), F.count("*").alias("n"), F.max("n").alias("most")).first()
    unit = level_of(totals.filter("source_size > 0"), float(total["s"] or 0) if target is None else float(target))
    wanted = F.when(F.col("source_size") > 0, F.least(F.col("cap"), F.col("weight") * F.lit(unit))).otherwise(0.0)
    plan = totals.withColumn("target", wanted).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    plan = plan.select("source_size", "target", F.struct("number", "rate", F.ceil(F.col("n") / CELL).alias("cells")).alias("_mix"), F.col("source").alias("_mix_source"))
    joined = look_up(sized, plan, {"source": "_mix_source"}, ["unit", "size"], total["n"])
    rate, whole = F.col("_mix.rate"), F.floor("_mix.rate").cast("long")
    spread = F.pmod(F.xxhash64("unit", "size"), F.col("_mix.cells")).cast("int")
    rest = joined.filter((rate > whole) & (F.col("size") > 0)).select("unit", F.col("_mix.number").alias("source"), "size", (rate - whole).alias("p"), spread.alias("cell"))
    rest = rest.groupBy("unit", "source", "size", "p", "cell").agg((F.col("size") * F.count("*")).alias("weight"))
    cells = max(1, math.ceil((total["most"] or 0) / CELL))
    shape = "unit long, source long, size long, weight long, p double"
    decided, level, kept_back = None, 0, None
    if cells > 1:
        rest = store.materialize(rest, tag)
        kept_back = rest.filter("cell = 0")
        rest = rest.filter("cell > 0")
    while cells > 1:
        flown = store.materialize(rest.groupBy("source", "cell").applyInArrow(_level(False, level), shape), tag)
        done = flown.filter("p = 0 or p = 1")
        decided = done if decided is None else decided.unionByName(done)
        cells = math.ceil(cells * 2 / CELL)
        level += 1
        rest = flown.filter("p > 0 and p < 1").withColumn("cell", F.expr(f"cast(pmod(xxhash64(unit, size), {cells}) as int)"))
    if kept_back is not None:
        rest = rest.unionByName(kept_back)
    flown = store.materialize(rest.withColumn("cell", F.lit(0)).groupBy("source", "cell").applyInArrow(_level(True, level), shape), tag)
    decided = flown if decided is None else decided.unionByName(flown)
    more = decided.filter("p = 1").select("unit", F.col("source").alias("_mix_number"), "size", F.lit(1).alias("_mix_extra"))
    out = joined.withColumn("_mix_number", F.col("_mix.number")).join(more, ["unit", "_mix_number", "size"], "left")
    taken = (F.col("size") * (F.floor("_mix.rate").cast("long") + F.coalesce("_mix_extra", F.lit(0)))).cast("long")
    return out.withColumn("taken", taken).drop("_mix", "_mix_number", "_mix_extra")


def sizes(documents: DataFrame) -> DataFrame:
    """(unit, source, size) of each row. A null doc_id counts as its own unit, by its text's hash."""
    unit = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text", "source"))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), unit.alias("unit"), "source", word_count().alias("size"))


def mixed(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` as often as the mix takes them, all columns unchanged; documents without words go."""
    unit = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text", "source"))
    taken = mix(store.materialize(sizes(documents), "sizes")).filter("taken > 0")
    taken = taken.select(F.col("unit").alias("_unit"), F.col("source").alias("_source"), F.col("size").alias("_size"), (F.col("taken") / F.col("size")).cast("int").alias("_copies")).distinct()
    rows = documents.select("*", unit.alias("_of_unit"), word_count().alias("_of_size"))
    same = (F.col("_of_unit") == F.col("_unit")) & (F.col("_of_size") == F.col("_size")) & F.col("source").eqNullSafe(F.col("_source"))
    copies = rows.join(taken, same).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return copies.select(*(rows[c] for c in documents.columns))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = store.materialize(sizes(spark.read.parquet(f"{sf_dir}/documents.parquet")), "sizes")
    return mix(sized).select("doc_id", "source", "size", "source_size", "target", "taken")
