"""Removes every byte that lies in a WINDOW-byte string which starts anywhere else too, by suffixes sorted to that depth with bucket-pointer refinement.

Sorting all suffixes of a corpus would move each byte many times. Here only those move that may have an equal:

1. A window's anchor is the leftmost of its GRAM-byte strings of least hash, so equal windows have equal anchors at equal places. These are the initial buckets.
   Neighbouring windows mostly share theirs: a document is some 170 bytes of window starts to a run. A run's key is (anchor, hash of all its bytes).
2. Runs are counted by key. One that occurs twice is all repeats; one whose anchor has no other key has none. For the others, one run of each key is read again.
3. It is cut where the distance to its anchor is a multiple of BLOCK. The bytes that all windows of such a block share, its core, are replaced by their hash: what is
   left, at most BLOCK - 1 bytes, the hash, and at most BLOCK - 1 bytes, has equal strings of RESIDUE bytes where the text has equal windows. Blocks alone with their core have no repeats.
4. The suffixes of the rest are sorted to RESIDUE bytes, in tasks of bounded bytes, by bucket-pointer refinement (Schuermann and Stoye, 2005): buckets of equal 8-byte strings
   are refined by the bucket of the suffix as many bytes later, and the new buckets by each other; a suffix alone in its bucket is settled. A core with more than KINDS blocks
   is settled by counting its residues one by one instead, with partial sums, as such a group may be of any size.

Hashes are 64-bit; two different runs are taken for equal only if their anchors' hashes and their own both collide, texts if two 64-bit hashes do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import store
from .kernels import _BACK, _BASE, U64, _power, mix, ragged, text_chunks
from .skew import meet

WINDOW = 400
GRAM = 64
REACH = WINDOW - GRAM + 1  # grams of a window
BLOCK = 32
CORE = WINDOW - BLOCK + 1
RESIDUE = BLOCK - 1 + 8
PIECE = 1 << 20  # bytes of a long text that are looked at once
PART = 1 << 21  # bytes of blocks that are sorted in one task
KINDS = 1 << 14

_rng = np.random.default_rng(0x400)
_CODE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)


class Hashes:
    """Hashes of any spans of some bytes, from one running sum."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.run = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODE[data] * _power(_BASE, n), out=self.run[1:])
        self.back = _power(_BACK, n + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.run[ends] - self.run[starts]) * self.back[starts]
        return mix(h + (ends - starts).astype(np.uint64) * U64(0x9E3779B97F4A7C15))

    def grams(self) -> np.ndarray:
        return mix((self.run[GRAM:] - self.run[:-GRAM]) * self.back[: len(self.run) - GRAM])


def least_in_reach(h: np.ndarray) -> np.ndarray:
    """The least of each REACH neighbouring values: blocks' running minima from both sides."""
    padded = np.full(-(-len(h) // REACH) * REACH, 2**64 - 1, np.uint64)
    padded[: len(h)] = h
    blocks = padded.reshape(-1, REACH)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: len(h) - REACH + 1], ahead[REACH - 1 : len(h)])


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, first, last, at, anchor, content, weight) of the runs of window starts, and (document, first, last) of those that recur in their own document. Of such
    one stands for all, with their number as its weight. Places are in ``data``; ``at`` is the anchor's distance from the first start."""
    none = np.zeros(0, np.int64)
    lengths = np.maximum(np.diff(offsets) - WINDOW + 1, 0)
    if not lengths.any():
        return (*(none,) * 4, none.view(np.uint64), none.view(np.uint64), none), (none,) * 3
    hashes = Hashes(data)
    h = hashes.grams()
    m = least_in_reach(h)
    valid = np.zeros(len(m), bool)
    valid[ragged(offsets[:-1], lengths)] = True
    begins = valid.copy()
    # another least value, or the place of the last one was left behind
    begins[1:] &= (m[1:] != m[:-1]) | (h[: len(m) - 1] == m[:-1])
    begins[offsets[:-1][lengths > 0]] = True
    first = np.flatnonzero(begins)
    document = np.searchsorted(offsets, first, side="right") - 1
    last = np.minimum(np.append(first[1:], len(data)) - 1, offsets[document + 1] - WINDOW)
    anchor, content = m[first], hashes.of(first, last + WINDOW)
    order = np.lexsort((first, content, anchor, document))
    same = np.zeros(len(order), bool)
    x, y = order[1:], order[:-1]
    same[1:] = (document[x] == document[y]) & (anchor[x] == anchor[y]) & (content[x] == content[y])
    heads = np.flatnonzero(~same)
    weight = np.diff(np.append(heads, len(order)))
    again = np.repeat(weight > 1, weight)
    own = (document[order[again]], first[order[again]], last[order[again]])
    kept = order[heads]
    at = np.empty(len(kept), np.int64)
    for a in range(0, len(kept), 4096):
        f = first[kept[a : a + 4096]]
        at[a : a + 4096] = (h[f[:, None] + np.arange(REACH)] == m[f][:, None]).argmax(axis=1)
    return (document[kept], first[kept], last[kept], at, anchor[kept], content[kept], weight), own


def merged(first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open spans, as disjoint ones in order."""
    if not len(first):
        return first, stop
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(stop[order])
    begins = np.append(True, first[1:] > reach[:-1])
    return first[begins], reach[np.append(np.flatnonzero(begins)[1:] - 1, len(first) - 1)]


def _packed(first: np.ndarray, last: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (first << 18) | ((last - first) << 9) | at


SCANNED = "doc_id long, d1 long, d2 long, n_bytes long, sha string, spans array<struct<from:long,to:long>>, members array<struct<anchor:long,content:long,place:long,weight:long>>"


def _lists(document: np.ndarray, n: int, fields: dict[str, np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(np.bincount(document, minlength=n))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in fields.values()], list(fields)))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in text_chunks(batch.column(3)):
            found, own = [], []
            # one long text in pieces: a run that is cut between two of them has keys of its own
            for base in range(0, max(len(data), 1), PIECE) if b - a == 1 else (0,):
                piece = data[base : base + PIECE + WINDOW - 1] if b - a == 1 else data
                (document, first, last, at, anchor, content, weight), (d, f, e) = runs(piece, np.array([0, len(piece)]) if b - a == 1 else offsets)
                zero = base - offsets[:-1]
                found.append((document, first + zero[document], last + zero[document], at, anchor.view(np.int64), content.view(np.int64), weight))
                own.append((d, f + zero[d], e + zero[d]))
            document, first, last, at, anchor, content, weight = (np.concatenate(x) for x in zip(*found))
            d, f, e = (np.concatenate(x) for x in zip(*own))
            cuts = np.searchsorted(d, np.arange(b - a + 1))
            spans = [merged(f[i:j], e[i:j] + WINDOW) for i, j in zip(cuts[:-1], cuts[1:])]
            counted = np.repeat(np.arange(b - a), [len(s[0]) for s in spans])
            spans = _lists(counted, b - a, {"from": np.concatenate([s[0] for s in spans]), "to": np.concatenate([s[1] for s in spans])})
            members = _lists(document, b - a, {"anchor": anchor, "content": content, "place": _packed(first, last, at), "weight": weight})
            sha = [hashlib.sha256(data[i:j]).hexdigest() for i, j in zip(offsets[:-1], offsets[1:])]
            keys = [batch.column(i).slice(a, b - a) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(np.diff(offsets), pa.int64()), pa.array(sha, pa.string()), spans, members], ["doc_id", "d1", "d2", "n_bytes", "sha", "spans", "members"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d1, d2, text, places) to blocks: (core, d1, d2, first, residue)."""
    for batch in batches:
        places = batch.column(3)
        ends = places.offsets.to_numpy().astype(np.int64)
        values = places.values.to_numpy()
        for a, b, data, offsets in text_chunks(batch.column(2)):
            place = values[ends[a] : ends[b]]
            row = np.repeat(np.arange(a, b), np.diff(ends[a : b + 1]))
            begin = offsets[row - a]
            first, more, at = place >> 18, (place >> 9) & 511, place & 511
            # windows by their distance t to the anchor, from the highest block to the lowest
            high, low = at // BLOCK, (at - more) // BLOCK
            n = high - low + 1
            k = np.repeat(np.arange(len(place)), n)
            block = high[k] - (np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n))
            anchor = first[k] + at[k]
            p, q = np.maximum(anchor - BLOCK * block - BLOCK + 1, first[k]), np.minimum(anchor - BLOCK * block, (first + more)[k])
            left, right = anchor - BLOCK * block, anchor - BLOCK * block + CORE  # of the core
            zero = begin[k]
            core = mix(Hashes(data).of(zero + left, zero + right) + block.astype(np.uint64) * U64(0xC2B2AE3D27D4EB4F)) if len(k) else np.zeros(0, np.uint64)
            x, y = left - p, q + WINDOW - right
            size = x + 8 + y
            stops = np.concatenate([[0], np.cumsum(size)])
            residue = np.empty(stops[-1], np.uint8)
            residue[ragged(stops[:-1], x)] = data[ragged(zero + p, x)]
            residue[(stops[:-1] + x)[:, None] + np.arange(8)] = core.astype("<u8").view(np.uint8).reshape(-1, 8)
            residue[ragged(stops[:-1] + x + 8, y)] = data[ragged(zero + right, y)]
            held = pa.Array.from_buffers(pa.large_binary(), len(k), [None, pa.py_buffer(stops), pa.py_buffer(residue)]).cast(pa.binary())
            keys = [batch.column(i).take(pa.array(row[k])) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), *keys, pa.array(p), held], ["core", "d1", "d2", "first", "residue"])


def refined(data: np.ndarray, ends: np.ndarray, depth: int, gram: int = 8) -> np.ndarray:
    """For each place of concatenated strings (``ends`` says for each place where its own string stops) whether the ``depth`` bytes from it also start elsewhere.

    Buckets of equal ``gram``-byte strings are refined by the bucket that lies as many bytes later; each round takes the buckets that the last one left. Places alone in
    their bucket are settled, and take no part in further rounds but as a bucket of their own."""
    n = len(data)
    out = np.zeros(n, bool)
    room = ends - np.arange(n)
    at = np.flatnonzero(room >= gram)
    grams = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(gram, np.uint8)]), gram)[at]
    keys = np.ascontiguousarray(grams).view(np.uint64).ravel()
    bucket = np.full(n, -1, np.int64)
    d = gram
    while True:
        _, number, count = np.unique(keys, return_inverse=True, return_counts=True)
        shared = count[number] > 1
        bucket[at] = number
        if d == depth:
            out[at] = shared
            return out
        at = at[shared]
        step = min(d, depth - d)
        at = at[room[at] >= d + step]
        if not len(at):
            return out
        # a place that leaves keeps its bucket, which no other place has
        keys = bucket[at] * np.int64(n + 1) + bucket[at + step]
        d += step


def _sorted(table: pa.Table) -> pa.Table:
    d1, d2, first = (table.column(c).to_numpy() for c in ("d1", "d2", "first"))
    order = np.lexsort((first, d2, d1))
    x, y = order[1:], order[:-1]
    once = order[np.append(True, (d1[x] != d1[y]) | (d2[x] != d2[y]) | (first[x] != first[y]))]  # repeated rows of one document
    table = table.take(pa.array(once))
    d1, d2, first = d1[once], d2[once], first[once]
    held = table.column("residue").combine_chunks().cast(pa.large_binary())
    offsets = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
    data = np.frombuffer(held.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    row = np.repeat(np.arange(len(held)), np.diff(offsets))
    again = np.flatnonzero(refined(data, offsets[1:][row], RESIDUE))
    begins = np.append(True, (np.diff(again) != 1) | (np.diff(row[again]) != 0)) if len(again) else np.zeros(0, bool)
    s = again[begins]
    e = again[np.append(np.flatnonzero(begins)[1:] - 1, len(again) - 1)] if len(again) else again
    r = row[s]
    start = first[r] + s - offsets[r]
    return pa.table({"d1": d1[r], "d2": d2[r], "from": start, "to": start + (e - s) + WINDOW})


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_removed, n_spans, sha = [], [], []
        for text, spans in zip(batch.column(2), batch.column(3)):
            text = (text.as_py() or "").encode()
            cut = spans.values.flatten()
            first, stop = merged(cut[0].to_numpy(), cut[1].to_numpy())
            left = b"".join(text[i:j] for i, j in zip([0, *stop.tolist()], [*first.tolist(), len(text)]))
            n_removed.append(len(text) - len(left))
            n_spans.append(len(first))
            sha.append(hashlib.sha256(left).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string())], ["d1", "d2", "n_removed", "n_spans", "kept_sha256"])


def _texts(documents: DataFrame) -> DataFrame:
    """(doc_id, d1, d2, text), d1 and d2 being hashes of the text."""
    text = F.coalesce("text", F.lit(""))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("d1"), F.xxhash64(F.lit("#"), text).alias("d2"), text.alias("text"))


def repeated_spans(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, d1, d2, n_bytes, sha, ...) for each row of ``documents(doc_id, text)``, (d1, d2, own, n, spans) of each distinct text with repeats): spans are half-open byte
    spans, which may overlap, ``own`` is the doc_id of one of its rows (0 for null) and ``n`` their number."""
    store.small_batches(documents.sparkSession)
    scanned = store.materialize(_texts(documents).mapInArrow(_scan, SCANNED), "scanned", "zstd")
    texts = store.materialize(scanned.groupBy("d1", "d2").agg(F.min(F.coalesce("doc_id", F.lit(0))).alias("own"), F.count("*").alias("n")), "texts")
    members = scanned.select("d1", "d2", F.explode("members").alias("m")).select("d1", "d2", "m.*")
    keys = members.groupBy("anchor", "content").agg(F.sum("weight").alias("n"), F.count("*").alias("rows"), F.min(F.struct("d1", "d2", "place")).alias("one"))
    keys = store.materialize(keys, "keys", "zstd")

    # runs that recur as they are
    again = meet(members.drop("weight"), keys.filter("n > 1").select("anchor", "content", F.col("rows").alias("n")), ["anchor", "content"], keys.agg(F.sum("rows")).first()[0] or 0)
    start, more = F.shiftright("place", 18), F.expr("shiftright(place, 9) & 511")
    again = again.select("d1", "d2", start.alias("from"), (start + more + WINDOW).alias("to"))

    # those that others with the same anchor may equal in part
    kinds = keys.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1")
    asked = meet(keys.select("anchor", "one"), kinds, ["anchor"], keys.count()).select("one.*")
    asked = asked.groupBy("d1", "d2").agg(F.collect_list("place").alias("places")).join(texts.select("d1", "d2", "own"), ["d1", "d2"])
    owned = _texts(documents).withColumn("own", F.coalesce("doc_id", F.lit(0))).drop("doc_id")
    read = owned.join(store.materialize(asked, "asked"), ["d1", "d2", "own"]).select("d1", "d2", "text", "places")
    blocks = store.materialize(read.mapInArrow(_cut, "core long, d1 long, d2 long, first long, residue binary"), "blocks")
    cores = store.materialize(blocks.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1").withColumn("kinds", F.col("n")), "cores")
    total = blocks.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("residue")), F.lit(0)).alias("size")).first()
    blocks = meet(blocks, cores, ["core"], total["n"])
    bucket = F.pmod("core", F.lit(total["size"] // PART + 1))
    few = blocks.filter(F.col("kinds") <= KINDS).groupBy(bucket.alias("bucket")).applyInArrow(_sorted, "d1 long, d2 long, from long, to long")
    each = blocks.filter(F.col("kinds") > KINDS).withColumn("j", F.explode(F.sequence(F.lit(0), F.octet_length("residue") - RESIDUE)))
    each = each.select(F.expr(f"substring(residue, j + 1, {RESIDUE})").alias("residue"), F.struct("d1", "d2", (F.col("first") + F.col("j")).alias("from")).alias("window"))
    common = each.groupBy("residue").agg(F.min("window").alias("least"), F.max("window").alias("most"), F.count("*").alias("n")).filter("least <> most").select("residue", "n")
    many = meet(each, store.materialize(common, "common"), ["residue"], total["n"] * BLOCK).select("window.*").withColumn("to", F.col("from") + WINDOW)

    local = scanned.select("d1", "d2", F.explode("spans").alias("s")).select("d1", "d2", "s.*")
    spans = again.unionByName(few).unionByName(many).unionByName(local).distinct()
    spans = spans.groupBy("d1", "d2").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    return scanned, store.materialize(texts.join(spans, ["d1", "d2"]), "spans")


def without_repeats(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of ``documents(doc_id, text)``: of a text's UTF-8 bytes, those are removed that a WINDOW-byte string covers which
    also starts anywhere else in any row's text, its own included. n_spans counts the maximal removed runs, kept_sha256 is that of the other bytes in their order.

    Strings never cross rows, and are judged on the texts as given. Null texts are empty; texts shorter than WINDOW keep all bytes; rows of one doc_id, and repeated rows, are texts
    of their own, so that a text of WINDOW bytes or more that occurs twice is removed whole. Other columns aren't read; an empty table gives no rows. Long texts are looked at in
    pieces of PIECE bytes; a text itself is held whole by a task.
    """
    scanned, spans = repeated_spans(documents)
    owned = _texts(documents).withColumn("own", F.coalesce("doc_id", F.lit(0))).drop("doc_id")
    cut = owned.join(spans.drop("n"), ["d1", "d2", "own"]).select("d1", "d2", "text", "spans")
    cut = cut.mapInArrow(_removed, "d1 long, d2 long, n_removed long, n_spans long, kept_sha256 string").dropDuplicates(["d1", "d2"])
    cut = store.materialize(cut.join(spans.select("d1", "d2", "n"), ["d1", "d2"]), "removed")
    rows = scanned.select("doc_id", "d1", "d2", "n_bytes", "sha")
    out = meet(rows, cut, ["d1", "d2"], rows.count(), how="left")
    return out.select("doc_id", "n_bytes", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_removed", "n_spans")), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Every window by its bytes' hash, spans by islands, and what is left between them.
OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
parts AS (SELECT r, p, substr(h, (2 * p + 1)::INT, 1798) AS h, least(n - 399 - p, 500) AS m FROM (SELECT r, h, n, unnest(range(0, n - 399, 500)) AS p FROM d WHERE n >= 400)),
w AS (SELECT r, p + i AS i, md5_number(substr(h, (2 * i + 1)::INT, 800)) AS k FROM (SELECT r, p, h, unnest(range(0, m)) AS i FROM parts)),
again AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
hit AS (SELECT r, i FROM w SEMI JOIN again USING (k)),
marked AS (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 400, true)::INT AS b FROM hit),
islands AS (SELECT r, i, sum(b) OVER (PARTITION BY r ORDER BY i) AS g FROM marked),
spans AS (SELECT r, min(i) AS s, max(i) + 400 AS e FROM islands GROUP BY r, g),
ends AS (SELECT r, s, e, lag(e, 1, 0) OVER (PARTITION BY r ORDER BY s) AS f FROM spans),
gaps AS (SELECT r, f AS a, s AS b FROM ends UNION ALL SELECT d.r, coalesce(max(e), 0), any_value(n) FROM d LEFT JOIN ends ON ends.r = d.r GROUP BY d.r),
kept AS (SELECT d.r, string_agg(substr(h, (2 * a + 1)::INT, (2 * (b - a))::INT), '' ORDER BY a) AS k FROM gaps JOIN d ON d.r = gaps.r GROUP BY d.r),
counts AS (SELECT r, sum(e - s)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans FROM spans GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(kept.k)) AS kept_sha256
FROM d JOIN kept ON kept.r = d.r LEFT JOIN counts ON counts.r = d.r
"""
