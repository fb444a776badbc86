"""Spelling variants: words that differ by one inserted, deleted or replaced code point, and the frequent form that each stands for.

Words are counted in whole texts. A word of length L that another word reaches by one edit at position i shares with it the first i code points and the
last L - 1 - i: in forward order these words are an interval of prefixes, in reverse order one of suffixes. Both together are a rectangle over the words of
length L, whose points a wavelet tree over their reverse ranks, held in forward order, reports.

Words are dealt to tasks so that every edit position has one task where both words are: an edit in the second half of the L positions leaves the first L div 2
code points alone, one in the first half leaves the others alone, so each word is sent under its first half and under its second, to length L (where it may
be found and ask for replacements) and to length L + 1 (where it asks for insertions; deletions are these, seen from the other word). Keys are dealt to
buckets of some PART code points; a key that holds more is cut into blocks, each met with each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import store
from .kernels import LOWER, ragged, text_chunks

LEAST_LENGTH, LEAST_N, FACTOR = 6, 5, 5
EVERY = 199  # one occurrence in so many loses a code point
PART = 1 << 20  # code points of one bucket's words
HELD = 1 << 18  # distinct words that a counting task holds before it passes them on
CHUNK = 1 << 18  # rectangles that are reported at once

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document) of the maximal runs of A-Z, a-z and U+00C0 to U+00FF in concatenated UTF-8 texts. The latter are the byte C3 and what follows."""
    ink = _LETTER[data]
    lead = data == 0xC3
    ink |= lead
    ink[1:] |= lead[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = ink[1:] != ink[:-1]
    edge[offsets] = True  # a run ends with its document
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    held = ink[starts]
    starts, ends = starts[held], ends[held]
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def seeded_crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: np.ndarray, short: int = 64) -> np.ndarray:
    """zlib.crc32(data[start:end], seed) of every span: all spans go on by one byte at a time, those longer than ``short`` by the library."""
    crc = ~seeds.astype(np.uint32)
    size = ends - starts
    live = np.flatnonzero(size <= short)
    at = 0
    while len(live := live[size[live] > at]):
        c = crc[live]
        crc[live] = _CRC[(c ^ data[starts[live] + at]) & 0xFF] ^ (c >> np.uint32(8))
        at += 1
    crc = ~crc
    for i in np.flatnonzero(size > short):
        crc[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(seeds[i]))
    return crc


def _occurrences(ids: list, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """(word, n) of the words of at least LEAST_LENGTH code points in concatenated texts."""
    data = LOWER[data]
    starts, ends, document = runs(data, offsets)
    tails = np.concatenate([[0], np.cumsum(data == 0xC3)])
    length = ends - starts - (tails[ends] - tails[starts])
    long = length >= LEAST_LENGTH  # deletions only shorten
    starts, ends, document, length = starts[long], ends[long], document[long], length[long]
    seeds = np.array([zlib.crc32(b"%s:" % (b"" if i is None else str(i).encode())) for i in ids], np.uint32)
    h = seeded_crc32(data, starts, ends, seeds[document]) if len(starts) else np.zeros(0, np.uint32)
    whole = h % EVERY != 0
    size = (ends - starts)[whole]
    stops = np.concatenate([[0], np.cumsum(size)])
    values = data[ragged(starts[whole], size)]
    kept = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(stops), pa.py_buffer(values)])
    cut = []
    for i in np.flatnonzero(~whole & (length > LEAST_LENGTH)):
        run = data[starts[i] : ends[i]].tobytes().decode()
        at = int(h[i]) % len(run)
        cut.append(run[:at] + run[at + 1 :])
    counted = pc.value_counts(pa.concat_arrays([kept, pa.array(cut, pa.large_string())]))
    return counted.field("values"), counted.field("counts")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []

    def passed() -> Iterator[pa.RecordBatch]:
        if held:
            summed = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])
            held.clear()
            yield from summed.cast(pa.schema([("word", pa.string()), ("n", pa.int64())])).to_batches(max_chunksize=1 << 16)

    for batch in batches:
        ids = batch.column(0).to_pylist()
        for a, b, data, offsets in text_chunks(batch.column(1)):
            held.append(pa.table(_occurrences(ids[a:b], data, offsets), names=["word", "n"]))
            if sum(t.num_rows for t in held) > HELD:
                yield from passed()
    yield from passed()


def count_words(documents: DataFrame) -> DataFrame:
    """(word, n) of all words with at least LEAST_N occurrences in ``documents(doc_id, text)``.

    A word is a maximal run of letters (A-Z, a-z, U+00C0 to U+00FF), A-Z lower-cased, of at least LEAST_LENGTH code points. With h the CRC-32 of
    ``<doc_id>:<run>``, the code point h modulo the run's length is taken out first where EVERY divides h. A null text has no words; a null doc_id is the empty string; repeated rows
    count each time; texts may be of any length. Columns other than these two aren't read. Tasks sum before words move.
    """
    store.small_batches(documents.sparkSession)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_N)


class WaveletTree:
    """Over a permutation: which of its values in given intervals lie at given intervals of places. A level holds one bit of each value, as running counts, in the
    order that the levels above have sorted them to."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length()) if len(values) else 1
        self.ones = []
        for b in reversed(range(self.bits)):
            bit = (values >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rectangle, value) of each value in [low, high) at the places [left, right). All rectangles go down together, a level at a time; a node without places
        or with other values ends."""
        one, value = np.arange(len(left)), np.zeros(len(left), np.int64)
        for b, ones in zip(reversed(range(self.bits)), self.ones):
            zeros = len(ones) - 1 - ones[-1]
            x, y = ones[left], ones[right]
            left, right = np.concatenate([left - x, zeros + x]), np.concatenate([right - y, zeros + y])
            one, value = np.concatenate([one, one]), np.concatenate([2 * value, 2 * value + 1])
            on = (left < right) & (value << b < high[one]) & ((value + 1) << b > low[one])
            left, right, one, value = left[on], right[on], one[on], value[on]
        return one, value


def _ordered(words: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common[k]: code points that the k-th and the next share) of the words by code points."""
    strings = np.array(words, dtype=f"U{length}")
    order = np.argsort(strings, kind="stable")
    codes = strings.view(np.uint32).reshape(len(words), length)[order]
    differ = codes[1:] != codes[:-1]
    return order, np.where(differ.any(axis=1), differ.argmax(axis=1), length)


class _Intervals:
    """For each row of an order the interval of found words that share ``depth`` code points with it."""

    def __init__(self, order: np.ndarray, common: np.ndarray, found: np.ndarray):
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.common = common
        self.before = np.concatenate([[0], np.cumsum(found[order])])

    def at(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        head = np.concatenate([[True], self.common < depth])
        starts = np.flatnonzero(head)
        block = (np.cumsum(head) - 1)[self.rank]
        return self.before[starts][block], self.before[np.append(starts[1:], len(head))][block]


def near_in(words: list[str], found: np.ndarray, length: int, first: int, stop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row that asks, row found) for words[found] of ``length`` code points and those that ask, of as many or one less, which differ by one edit at a position of
    [first, stop): each pair once, at the last position where the edit can be. Only positions where some words part are looked at, so that few long words
    take no longer than their letters."""
    forward, common = _ordered(words, length)
    ahead = _Intervals(forward, common, found)
    backward, shared = _ordered([w[::-1] for w in words], length)
    behind = _Intervals(backward, shared, found)
    f, g = forward[found[forward]], backward[found[backward]]  # found words in both orders
    place = np.empty(len(words), np.int64)
    place[g] = np.arange(len(g))
    tree = WaveletTree(place[f])
    codes = np.array(words, dtype=f"U{length}").view(np.uint32).reshape(len(words), length)
    asks = ~found
    for i in np.unique(common):
        if not first <= i < stop:
            continue
        left, right = ahead.at(i)
        narrow_left, narrow_right = ahead.at(i + 1)
        low, high = behind.at(length - 1 - i)
        rows = np.flatnonzero(asks & (right - left > narrow_right - narrow_left) & (low < high))
        for a in range(0, len(rows), CHUNK):
            r = rows[a : a + CHUNK]
            one, value = tree.report(left[r], right[r], low[r], high[r])
            x, y = r[one], g[value]
            parted = codes[x, i] != codes[y, i]
            yield x[parted], y[parted]


def _near(table: pa.Table) -> pa.Table:
    length, side = table.column("length")[0].as_py(), table.column("side")[0].as_py()
    words, n = table.column("word").to_pylist(), table.column("n").to_numpy()
    found = table.column("found").to_numpy()
    word, near = [], []
    if found.any() and not found.all():
        size = np.array([len(w) for w in words])
        half = length // 2
        for x, y in near_in(words, found, length, *((half, length) if side == 0 else (0, half))):
            shorter = size[x] < length
            word += [x, y[shorter]]
            near += [y, x[shorter]]
    word, near = (np.concatenate([np.zeros(0, np.int64), *parts]) for parts in (word, near))
    held = table.column("word").combine_chunks()
    return pa.table({"word": held.take(pa.array(word)), "near": held.take(pa.array(near)), "near_n": pa.array(n[near], pa.int64())})


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every ordered pair of near words of ``words(word, n)``, once. Words are distinct, not null, without U+0000 and of two code points at
    least. Each goes under two halves to two lengths, six rows in all. The keys of which more than PART code points are found are fewer than twice those of all
    words by PART; they are sent to their rows."""
    size = F.length("word")
    halves = [(0, F.expr("substring(word, 1, length(word) div 2)")), (1, F.expr("substring(word, length(word) div 2 + 1)"))]
    longer = [(0, F.expr("substring(word, 1, (length(word) + 1) div 2)")), (1, F.expr("substring(word, (length(word) + 1) div 2)"))]
    sent = [F.struct(size.alias("length"), F.lit(s).alias("side"), k.alias("key"), F.lit(f).alias("found")) for s, k in halves for f in (True, False)]
    sent += [F.struct((size + 1).alias("length"), F.lit(s).alias("side"), k.alias("key"), F.lit(False).alias("found")) for s, k in longer]
    dealt = words.select("word", "n", F.explode(F.array(*sent)).alias("s")).select("word", "n", "s.*")
    dealt = dealt.withColumn("key", F.xxhash64("length", "side", "key"))
    held = dealt.filter("found").groupBy("key").agg(F.sum("length").alias("held"))
    parts = held.filter(F.col("held") > PART).select("key", F.ceil(F.col("held") / PART).cast("int").alias("parts"))
    total = words.agg(F.sum(size)).first()[0] or 0
    dealt = dealt.join(F.broadcast(parts), "key", "left")
    block = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    others = F.expr("sequence(0, parts - 1)")
    blocks = F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))))
    blocks = blocks.when(F.col("found"), F.transform(others, lambda o: F.struct(block.alias("i"), o.cast("int").alias("j"))))
    blocks = blocks.otherwise(F.transform(others, lambda o: F.struct(o.cast("int").alias("i"), block.alias("j"))))
    bucket = F.when(F.col("parts").isNull(), F.pmod("key", F.lit(total // PART + 1))).otherwise(F.col("key"))
    dealt = dealt.select("word", "n", "found", "length", "side", bucket.alias("bucket"), F.col("parts").isNotNull().alias("cut"), F.explode(blocks).alias("b"))
    dealt = dealt.select("word", "n", "found", "length", "side", "bucket", "cut", "b.i", "b.j")
    return dealt.groupBy("length", "side", "bucket", "cut", "i", "j").applyInArrow(_near, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms(word, form)``, a forest: each word's last form. Pointers are doubled until none has another to follow; each round is written."""
    at = store.materialize(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = store.materialize(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        at = step.drop("moved")
        if step.filter("moved").isEmpty():
            return at


def variants(documents: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of ``documents(doc_id, text)`` (see ``count_words``).

    A word's form is its near word of largest n (ties: the smallest in code-point order), if that is at least FACTOR times its own n; else null, as form_n. root follows forms to the
    last, and is the word itself where it has none. n_near counts its near words. An empty table gives no rows.
    """
    words = store.materialize(count_words(documents), "words")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("top"))
    found = words.join(near, "word", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)))
    formed = -F.col("top.n") >= FACTOR * F.col("n")
    found = found.select("word", F.when(formed, F.col("top.near")).alias("form"), "n", "n_near", F.when(formed, -F.col("top.n")).alias("form_n"))
    found = store.materialize(found, "variants")
    rooted = found.join(roots(found.filter("form is not null")), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: CRC-32 by its table, near words by their shared prefix and suffix, roots by recursion.
OP11_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
found AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS w FROM documents),
each_doc AS (SELECT d, w, count(*) AS n FROM found WHERE length(w) >= 6 GROUP BY d, w),
hashed AS (
  SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(d || ':' || w, ''), lambda c:
    CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [(192 + (unicode(c) >> 6))::BIGINT, (128 + (unicode(c) & 63))::BIGINT] END))),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h FROM each_doc, crc),
cut AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
spots AS (SELECT word, unnest(range(0, length(word))) AS i FROM words),
holes AS (SELECT word, i, left(word, i::INT) AS p, substr(word, i::INT + 2) AS s FROM spots),
inserted AS (SELECT DISTINCT h.word AS a, w.word AS b FROM holes h JOIN words w ON w.word = h.p || h.s),
pairs AS (
  SELECT a.word AS a, b.word AS b FROM holes a JOIN holes b ON a.i = b.i AND a.p = b.p AND a.s = b.s AND a.word <> b.word
  UNION ALL SELECT a, b FROM inserted UNION ALL SELECT b, a FROM inserted),
ranked AS (SELECT a, b, w.n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY w.n DESC, b) AS r FROM pairs JOIN words w ON w.word = b),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN r.n >= 5 * w.n THEN b END AS form, CASE WHEN r.n >= 5 * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.a = w.word AND r.r = 1),
walk(word, last, form) AS (SELECT word, word, form FROM forms UNION ALL SELECT k.word, f.word, f.form FROM walk k JOIN forms f ON f.word = k.form)
SELECT f.word, f.form, k.last AS root, f.n, f.n_near, f.form_n FROM forms f JOIN walk k ON k.word = f.word AND k.form IS NULL
"""
