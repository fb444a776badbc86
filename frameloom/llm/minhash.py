"""Near-duplicates by a signature-coordinate inverted join.

A document's set is its distinct 5-word shingles (words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased); two documents are
linked when 100 * intersection >= 85 * union of the full sets. The steps:

1. Signatures: 64 MinHash coordinates per document. Documents of equal sets fall into one class, which goes on as one node. Classes of one doc_id (its rows differ) are joined at once.
2. Posts: each node under each (coordinate, value). Lists of one node end here; a node with fewer than ``MATCHES`` lists left
   can't agree with any other in ``MATCHES`` coordinates and ends too.
3. Prefix: each node keeps its ``COORDINATES - MATCHES + 1`` shortest lists, lists of one included. Two nodes that agree in
   ``MATCHES`` coordinates meet in one of these, as both order their lists alike.
4. Skip: each list's most central node (the one whose lists are longest in sum) is linked to the others if their full sets
   say so. That is linear in the posts, and joins nearly all of a group of copies around its original.
   What these links have joined is skipped from then on: only nodes of a list outside its largest component are still
   compared, in blocks, with the list's nodes of other components. Pairs with ``MATCHES`` equal coordinates are joined to
   groups, and each group's full sets are compared in blocks. A block returns edges that join what it found alike, fewer than
   it has nodes, so a large group of copies never becomes all its pairs.

A pair at similarity 0.85 has 54.4 equal coordinates on average with a deviation of 2.9, so one in some 7 million such pairs
falls below ``MATCHES``; at 0.9 one in 10**10.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import store
from .components import components
from .kernels import U64, mix, text_chunks, word_hashes, word_spans
from .skew import meet

WORDS = 5
COORDINATES = 64
MATCHES = 38
NUMERATOR, DENOMINATOR = 85, 100
LINKS = 512  # of one center, in one task
FEW, MANY = 256, 2048  # nodes in the two blocks of a list that are compared at once
FEW_SHINGLES, MANY_SHINGLES = 1 << 17, 1 << 20  # those of a group

_rng = np.random.default_rng(20260724)
_FLIP = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64)[:, None]
_SPIN = (_rng.integers(0, 2**63, COORDINATES, dtype=np.uint64) * U64(2) + U64(1))[:, None]
_PLACE = _rng.integers(0, 2**63, WORDS, dtype=np.uint64) * U64(2) + U64(1)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text the sorted, distinct hashes of its shingles."""
    for a, b, data, offsets in text_chunks(texts, 1 << 18):
        starts, ends, first = word_spans(data, offsets)
        h = word_hashes(data, starts, ends)
        n = len(h)
        full = np.zeros(max(n - WORDS + 1, 0), np.uint64)
        for k in range(WORDS):
            full += h[k : k + len(full)] * _PLACE[k]
        full = mix(full)
        for d in range(b - a):
            i, j = first[d], first[d + 1]
            if j - i >= WORDS:
                yield np.unique(full[i : j - WORDS + 1])
            elif j > i:
                yield mix((h[i:j] * _PLACE[: j - i]).sum(keepdims=True, dtype=np.uint64) + U64(j - i))
            else:
                yield h[:0]


def signature(shingles: np.ndarray) -> np.ndarray:
    """The upper 32 bits of the least hash in each coordinate, as int32."""
    least = np.full(COORDINATES, 2**64 - 1, np.uint64)
    for i in range(0, len(shingles), 2048):
        x = shingles[i : i + 2048] ^ _FLIP
        x *= _SPIN
        np.minimum(least, x.min(axis=1), out=least)
    return (least >> U64(32)).astype(np.uint32).view(np.int32)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, h1, h2, signs = [], [], [], []
        for s in shingle_sets(batch.column(1)):
            n.append(len(s))
            a, b = _sums(s)
            h1.append(a)
            h2.append(b)
            signs.append(signature(s) if len(s) else None)
        flat = np.concatenate([s if s is not None else np.zeros(COORDINATES, np.int32) for s in signs]) if signs else np.zeros(0, np.int32)
        signs = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * COORDINATES), pa.array(flat))
        columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), signs]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "h1", "h2", "sign"])


def _sums(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that tell sets apart, as signed numbers."""
    h1, h2 = (mix(s ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64), mix(s + U64(0x1234567890ABCDEF)).sum(dtype=np.uint64))
    return int(h1.view(np.int64)), int(h2.view(np.int64))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of (node, text, h1, h2) whose text is that of the node."""
    for batch in batches:
        wanted = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()))
        sets = [s if _sums(s) == w else None for s, w in zip(shingle_sets(batch.column(1)), wanted)]
        own = [i for i, s in enumerate(sets) if s is not None]
        sets = [sets[i] for i in own]
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["node", "shingles"])


def _forest(few: np.ndarray, many: np.ndarray, near) -> tuple[list, list]:
    """Edges that join all of one block's rows that ``near`` finds near to each other, none of them superfluous: their number is below
    that of the rows. ``near(i)`` says which of ``many`` are near to row i."""
    label = np.arange(len(few) + len(many))
    a, b = [], []
    for i in few:
        found = many[near(i)]
        found = found[label[found] != label[i]]
        if len(found):
            old, one = np.unique(label[found], return_index=True)
            a += [i] * len(one)
            b += found[one].tolist()
            label[np.isin(label, old)] = label[i]
    return a, b


def _edges(table: pa.Table, near_of) -> pa.Table:
    side = table.column("few").to_numpy()
    node = table.column("node").to_numpy()
    few, many = np.flatnonzero(side), np.flatnonzero(~side)
    # a node that stands on both sides is one row of the forest's many, found again by its number
    a, b = _forest(few, many, near_of(few, many))
    return pa.table({"a": pa.array(np.maximum(node[a], node[b]) if a else [], pa.int64()), "b": pa.array(np.minimum(node[a], node[b]) if a else [], pa.int64())})


def _alike(table: pa.Table):
    """Rows in different components whose sizes allow a link."""
    root, size = (table.column(c).to_numpy() for c in ("root", "n_shingles"))

    def alike(i: int, many: np.ndarray) -> np.ndarray:
        return (root[many] != root[i]) & (DENOMINATOR * np.minimum(size[many], size[i]) >= NUMERATOR * np.maximum(size[many], size[i]))

    return alike


def _compare(table: pa.Table) -> pa.Table:
    """Of one list's block pair, edges that join the nodes with at least MATCHES equal coordinates."""
    sign = table.column("sign").combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)
    alike = _alike(table)

    def near_of(few: np.ndarray, many: np.ndarray):
        block = np.ascontiguousarray(sign[many])
        return lambda i: (np.count_nonzero(block == sign[i], axis=1) >= MATCHES) & alike(i, many)

    return _edges(table, near_of)


def _verify(table: pa.Table) -> pa.Table:
    """Of one group's block pair, edges that join the nodes whose full sets are similar enough."""
    sets = table.column("shingles").combine_chunks()
    stop = sets.offsets.to_numpy().astype(np.int64)
    values = sets.values.to_numpy()
    alike = _alike(table)

    def near_of(few: np.ndarray, many: np.ndarray):
        known, number = np.unique(np.concatenate([values[stop[i] : stop[i + 1]] for i in many]), return_inverse=True)
        size = stop[many + 1] - stop[many]
        begin = np.cumsum(size) - size

        def near(i: int) -> np.ndarray:
            own = values[stop[i] : stop[i + 1]]
            held = np.zeros(len(known), np.int64)
            at = np.searchsorted(known, own).clip(0, len(known) - 1)
            held[at[known[at] == own]] = 1
            both = np.add.reduceat(held[number], begin)
            return alike(i, many) & (DENOMINATOR * both >= NUMERATOR * (size + len(own) - both))

        return near

    return _edges(table, near_of)


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (center, node) whose full sets are similar enough, as (a, b) with a > b. A center's set is sent once for each LINKS of its pairs, so
    that no task holds more of them."""
    centers = pairs.groupBy("center").agg(F.count("*").alias("n"), F.ceil(F.count("*") / LINKS).cast("int").alias("parts"))
    centers = store.materialize(centers, "centers")
    dealt = meet(pairs, centers, ["center"], pairs.count()).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).drop("parts")
    right = sets.select("node", F.col("shingles").alias("y"))
    left = sets.withColumnRenamed("node", "center").join(centers.select("center", "parts"), "center")
    left = left.select("center", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("shingles").alias("x"))
    joined = dealt.join(right, "node").join(left, ["center", "part"])
    both = F.size(F.array_intersect("x", "y"))
    sized = joined.select(F.greatest("node", "center").alias("a"), F.least("node", "center").alias("b"), F.size("x").alias("n"), F.size("y").alias("m"), both.alias("i"))
    return sized.filter(DENOMINATOR * F.col("i") >= NUMERATOR * (F.col("n") + F.col("m") - F.col("i"))).select("a", "b")


def prefix_lists(nodes: DataFrame) -> DataFrame:
    """(key, node, central): each node under the keys of its prefix that another node has too. Lists are counted by partial sums; the count of
    a list with a large part of all posts is sent to them."""
    posts = nodes.select("node", F.posexplode("sign").alias("at", "value"))
    posts = posts.select("node", F.expr("shiftleft(cast(at as bigint), 32) | (cast(value as bigint) & 4294967295)").alias("key"))
    counted = posts.groupBy("key").agg(F.count("*").alias("n"), F.count("*").alias("held")).filter("n > 1")
    counted = store.materialize(counted, "counts")
    shared = meet(posts, counted, ["key"], COORDINATES * nodes.count())
    held = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct(F.col("held").alias("n"), "key"))).alias("held"), F.sum("held").alias("central"))
    held = held.filter(F.size("held") >= MATCHES)
    prefix = F.slice("held", F.lit(1), F.size("held") - (MATCHES - 1))
    return held.select("node", "central", F.explode(prefix).alias("post")).select(F.col("post.key").alias("key"), "node", "central")


def _blocks(held: DataFrame, key: str, few: F.Column, fews: F.Column, manies: F.Column) -> DataFrame:
    """``held`` twice over, for comparing the rows that are ``few`` with all rows of their key: the first in ``fews`` blocks i, each met
    with ``manies`` blocks j of all rows."""
    block = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    held = held.withColumn("fews", fews.cast("int")).withColumn("manies", manies.cast("int"))
    left = held.filter(few).withColumn("few", F.lit(True)).withColumn("i", block(F.col("fews"))).withColumn("j", F.explode(F.expr("sequence(0, manies - 1)")))
    right = held.withColumn("few", F.lit(False)).withColumn("j", block(F.col("manies"))).withColumn("i", F.explode(F.expr("sequence(0, fews - 1)")))
    return left.unionByName(right).select(key, "i", "j", "few", "node", "root")


def _unjoined(lists: DataFrame, roots: DataFrame, n_posts: int) -> DataFrame:
    """Blocks of lists that still hold several components: nodes outside the list's largest one against all of the list."""
    rooted = lists.select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = rooted.groupBy("key", "root").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all"), F.count("*").alias("roots")).filter("roots > 1")
    largest = store.materialize(largest.select("key", F.col("all").alias("n"), "top", "all"), "open")
    held = meet(rooted, largest, ["key"], n_posts)
    return _blocks(held, "key", F.col("root") != F.col("top.root"), F.ceil((F.col("all") - F.col("top.n")) / FEW), F.ceil(F.col("all") / MANY))


def _ungrouped(groups: DataFrame, roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """Blocks of groups of nodes that may be linked, each block of a bounded number of shingles."""
    held = groups.select("node", F.col("root").alias("key")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    held = held.join(nodes.select("node", "n_shingles"), "node")
    sums = held.groupBy("key").agg(F.sum("n_shingles").alias("n"))
    held = held.join(sums, "key")
    return _blocks(held, "key", F.lit(True), F.ceil(F.col("n") / FEW_SHINGLES), F.ceil(F.col("n") / MANY_SHINGLES))


def _ties(keyed: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges between the classes of one doc_id whose rows differ in their texts."""
    one = F.struct("h1", "h2", "n_shingles")
    several = keyed.groupBy("doc_id").agg(F.min(one).alias("least"), F.max(one).alias("most")).filter("least <> most").select("doc_id")
    held = keyed.join(several, "doc_id", "left_semi").select("doc_id", "h1", "h2", "n_shingles").distinct().join(classes.select("h1", "h2", "n_shingles", "node"), ["h1", "h2", "n_shingles"])
    held = store.materialize(held.select("doc_id", "node"), "ties")
    least = held.groupBy("doc_id").agg(F.min("node").alias("b"))
    return held.join(least, "doc_id").filter("node <> b").select(F.col("node").alias("a"), "b").distinct()


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, kept) for each row of ``documents(doc_id, text)``.

    class_id is the smallest doc_id with the same set, component_id the smallest that links reach. Null, empty and blank
    texts have no shingles and are linked with nothing. Repeated rows of one document give repeated results; where rows of
    one doc_id differ in their texts, each has its own class, and these are of one component, with all that any of them is linked with. A null doc_id is linked with nothing: its component is null
    and it isn't kept. Columns other than doc_id and text are neither read nor returned. A text, and its set, are held whole by a task.
    """
    store.small_batches(documents.sparkSession)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signs = store.materialize(texts.mapInArrow(_sign, "doc_id long, n_shingles long, h1 long, h2 long, sign array<int>"), "signs")
    keyed = signs.filter("doc_id is not null and n_shingles > 0")
    classes = keyed.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n"))
    classes = store.materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    # a class is a node: its signature and its set are those of one text of its smallest doc_id
    chosen = classes.select(F.col("class_id").alias("doc_id"), "h1", "h2", "n_shingles", "node")
    nodes = keyed.join(chosen, ["doc_id", "h1", "h2", "n_shingles"]).select("node", "doc_id", "h1", "h2", "n_shingles", "sign").dropDuplicates(["node"])
    nodes = store.materialize(nodes, "nodes")
    lists = store.materialize(prefix_lists(nodes), "lists")
    n_posts = lists.count()
    centers = lists.groupBy("key").agg(F.max(F.struct("central", -F.col("node"))).alias("top"), F.count("*").alias("n")).filter("n > 1").select("key", "n", (-F.col("top.col2")).alias("center"))
    stars = meet(lists.select("key", "node"), centers, ["key"], n_posts).filter("node <> center").select("center", "node").distinct()
    stars = store.materialize(stars, "stars")
    used = nodes.select("node", "doc_id", "h1", "h2").join(lists.select("node").distinct(), "node", "left_semi").hint("shuffle_hash")
    owned = texts.join(used, "doc_id").select("node", "text", "h1", "h2").mapInArrow(_sets, "node long, shingles array<long>")
    sets = store.materialize(owned.dropDuplicates(["node"]), "sets")
    links = store.materialize(_confirm(stars, sets), "links")
    links = links.unionByName(_ties(keyed, classes))
    roots = components(links)
    left = _unjoined(lists, roots, n_posts).join(nodes, "node").groupBy("key", "i", "j").applyInArrow(_compare, "a long, b long")
    left = store.materialize(left, "alike")
    if not left.isEmpty():
        blocks = _ungrouped(components(left), roots, nodes).join(nodes.select("node", "n_shingles"), "node").join(sets, "node")
        more = blocks.groupBy("key", "i", "j").applyInArrow(_verify, "a long, b long")
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    rooted = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("class_id").alias("component_id"), F.count("*").alias("kinds"))
    rooted = rooted.select("root", "h1", "h2", "n_shingles", "class_id", "n")
    found = meet(rooted, least.withColumnRenamed("kinds", "_kinds"), ["root"], classes.count(), n="_kinds").drop("root")
    out = keyed.select("doc_id", "n_shingles", "h1", "h2")
    out = meet(out, found, ["h1", "h2", "n_shingles"], out.count()).drop("h1", "h2")
    out = out.unionByName(signs.filter("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles"), allowMissingColumns=True)
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    out = out.select("doc_id", "n_shingles", *(F.when(alone, F.col("doc_id")).otherwise(F.col(c)).alias(c) for c in ("class_id", "component_id")))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(False)))


def one_of_each(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` without those whose document another stands for. Rows without doc_id stay, as do repeated rows of a
    document that is kept."""
    gone = near_duplicates(documents).filter("not kept and doc_id is not null").select(F.col("doc_id").alias("_gone")).distinct()
    return documents.join(gone, documents["doc_id"] == gone["_gone"], "left_anti")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_shingles", "component_id", "kept", "class_id")
