"""Toxic spans by a linear-chain conditional random field over words, with labels 0 (clean) and 1 (toxic).

Learning, from a bounded sample of labelled rows (``TOXIC_ROWS`` and ``CLEAN_ROWS``, least hash first):

1. Features of a word: its core (A-Z lower-cased, without ASCII punctuation at its ends), the core's prefixes and suffixes of
   some lengths. Those that toxic documents hold far oftener (likelihood ratio at least ``RATIO``) form the lexicon.
2. Token labels are learned from the documents' (a toxic one has at least one toxic token, a clean one has none). At first, words of toxic
   documents with a lexicon feature that clean documents hardly have are toxic. After each fit, those are that the model then finds
   toxic, and in a toxic document without any its likeliest lexicon word; ``ROUNDS`` times.
3. Feature weights and transitions are fitted by the gradient of the likelihood to windows of ``WINDOW`` tokens, from anywhere in the text: of each
   document those that hold a word labelled toxic at first, ``WINDOWS`` of the others with a lexicon word, drawn by hash and weighted so
   that they stand for all of these, and one that its length picks. Windows without lexicon words are alike, so they are counted.

Scoring runs over whole texts. Words without lexicon features all have the same potentials, so a run of them is one power of a
2 x 2 matrix, and forward-backward steps only from one lexicon word to the next; the marginals are those of the full chain.
A document's evidence is the chance that one of its lexicon words is toxic, taken as independent given the marginals; its score is a
logistic function of the evidence, fitted to the sample's labels, as chance finds make weak evidence in clean documents too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import store
from .kernels import _BYTE, LOWER, HashTable, mix, span_hashes, text_chunks, word_hashes, word_spans

TOXIC_ROWS, CLEAN_ROWS = 3000, 5000
RATIO = 24.0
LIKELY, SURE = 0.95, 0.99
WINDOW = 32
WINDOWS = 6
STEPS, AGAIN, RATE, DECAY, CLOSE = 150, 40, 0.15, 1e-4, 2e-5
ROUNDS = 2
AFFIXES = (3, 4, 5, 6)
CACHE = 1 << 19

_SOLID = np.zeros(256, bool)
_SOLID[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_KIND = np.random.default_rng(7).integers(0, 2**63, 2 * len(AFFIXES) + 1, dtype=np.uint64)


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(words, 2 * len(AFFIXES) + 1) feature hashes; 0 where a word is too short for an affix."""
    solid = np.concatenate([[0], np.cumsum(_SOLID[data])])
    at = np.flatnonzero(_SOLID[data])
    some = solid[ends] > solid[starts]
    a, b = starts.copy(), starts.copy()
    if some.any():
        a[some], b[some] = at[solid[starts[some]]], at[solid[ends[some]] - 1] + 1
    values = _BYTE[LOWER[data]]
    out = np.zeros((len(starts), len(_KIND)), np.uint64)
    out[some, 0] = span_hashes(values, a[some], b[some]) ^ _KIND[0]
    for i, n in enumerate(AFFIXES):
        long = b - a > n
        out[long, 2 * i + 1] = span_hashes(values, a[long], a[long] + n) ^ _KIND[2 * i + 1]
        out[long, 2 * i + 2] = span_hashes(values, b[long] - n, b[long]) ^ _KIND[2 * i + 2]
    return out


def _document_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for lo, hi, data, offsets in text_chunks(batch.column(0), 1 << 19):
            starts, ends, first = word_spans(data, offsets)
            f = features(data, starts, ends)
            for side in (False, True):
                seen = [np.unique(f[first[d - lo] : first[d - lo + 1]]) for d in range(lo, hi) if toxic[d] == side]
                codes, n = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                n = n.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(n * side), pa.array(n * (not side))], ["feature", "toxic", "clean"])


def _windows(lexicon: np.ndarray, sure: np.ndarray):
    """A function from (text, toxic) rows to windows: their document and whether it is toxic, places and lexicon numbers of their features, and places
    labelled toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        before = TaskContext.get().partitionId() << 32
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            places, numbers, labelled, sizes, owners, weights = [], [], [], [], [], []
            for lo, hi, data, offsets in text_chunks(batch.column(0), 1 << 19):
                starts, ends, first = word_spans(data, offsets)
                f = features(data, starts, ends)
                number = np.searchsorted(lexicon, f).clip(0, max(len(lexicon) - 1, 0))
                known = (lexicon[number] == f) & (f != 0)
                marked = (known & sure[number]).any(axis=1)
                for d in range(lo, hi):
                    i, j = first[d - lo], first[d - lo + 1]
                    if i == j:
                        continue
                    held = np.unique(np.flatnonzero(known[i:j].any(axis=1)) // WINDOW)
                    sure_ones = np.unique(np.flatnonzero(marked[i:j]) // WINDOW) if toxic[d] else held[:0]
                    rest = np.setdiff1d(held, sure_ones)
                    length = offsets[d - lo + 1] - offsets[d - lo]
                    drawn = rest[np.argsort(mix(rest.astype(np.uint64) + np.uint64(length)), kind="stable")[:WINDOWS]]
                    one = int(mix(np.array([length], np.uint64))[0]) % -(-int(j - i) // WINDOW)
                    picked = dict.fromkeys(drawn.tolist(), len(rest) / max(len(drawn), 1)) | dict.fromkeys(sure_ones.tolist(), 1.0)
                    picked.setdefault(one, 1.0)
                    for w, weight in sorted(picked.items()):
                        at = slice(i + w * WINDOW, min(i + (w + 1) * WINDOW, j))
                        p, k = np.nonzero(known[at])
                        places.append(p.tolist())
                        numbers.append(number[at][p, k].tolist())
                        labelled.append(np.flatnonzero(marked[at]).tolist() if toxic[d] else [])
                        sizes.append(at.stop - at.start)
                        owners.append(before + d)
                        weights.append(weight)
            marks = [pa.array(owners, pa.int64()), pa.array([bool(toxic[o - before]) for o in owners], pa.bool_()), pa.array(sizes, pa.int32()), pa.array(weights, pa.float64())]
            yield pa.RecordBatch.from_arrays([*marks, *(pa.array(x, pa.list_(pa.int32())) for x in (places, numbers, labelled))], ["doc", "toxic", "size", "weight", "places", "numbers", "labelled"])
            before += batch.num_rows

    return run


def _spread(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks()
    rows = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    return rows, column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def fit(windows: pa.Table, n_features: int) -> tuple[np.ndarray, float, np.ndarray]:
    """(weights, bias, transitions): Adam on the mean log-likelihood of the windows' labels, which are learned anew ROUNDS times."""
    bare = pc.equal(pc.list_value_length(windows.column("places")), 0)
    counted = windows.filter(bare).group_by("size").aggregate([("weight", "sum")]).sort_by("size")
    windows = windows.filter(pc.invert(bare))
    n = windows.num_rows + counted.num_rows
    size = np.concatenate([windows.column("size").to_numpy(), counted.column("size").to_numpy()])
    weight = np.concatenate([windows.column("weight").to_numpy(), counted.column("weight_sum").to_numpy()])
    row, place = _spread(windows.column("places"))
    _, number = _spread(windows.column("numbers"))
    y_row, y_place = _spread(windows.column("labelled"))
    y = np.zeros((n, WINDOW), np.int64)
    y[y_row, y_place] = 1
    live = np.arange(WINDOW) < size[:, None]
    cell = row * WINDOW + place
    theta = np.zeros(n_features + 5)
    theta[n_features] = -2.0
    theta = _climb(theta, y, live, weight, cell, number, STEPS)
    # lexicon words of toxic documents, with their documents' numbers
    cells = np.unique(cell)
    cells = cells[windows.column("toxic").to_numpy(zero_copy_only=False).astype(bool)[cells // WINDOW]]
    _, owner = np.unique(windows.column("doc").to_numpy()[cells // WINDOW], return_inverse=True)
    for _ in range(ROUNDS if len(cells) else 0):
        p = _posteriors(_emissions(theta, live, cell, number), live, theta[n_features + 1 :].reshape(2, 2))[0].ravel()[cells]
        top = np.lexsort((-p, owner))
        first = top[np.concatenate([[True], np.diff(owner[top]) > 0])]
        toxic = p >= 0.5
        toxic[first] = True
        y = np.zeros(n * WINDOW, np.int64)
        y[cells[toxic]] = 1
        theta = _climb(theta, y.reshape(n, WINDOW), live, weight, cell, number, AGAIN)
    return theta[:n_features], float(theta[n_features]), theta[n_features + 1 :].reshape(2, 2)


def _emissions(theta: np.ndarray, live: np.ndarray, cell: np.ndarray, number: np.ndarray) -> np.ndarray:
    e = np.full(live.shape, theta[-5])
    e += np.bincount(cell, theta[number], live.size).reshape(live.shape)
    e[~live] = 0
    return e


def _climb(theta: np.ndarray, y: np.ndarray, live: np.ndarray, weight: np.ndarray, cell: np.ndarray, number: np.ndarray, steps: int) -> np.ndarray:
    """At most ``steps`` of Adam from ``theta`` (weights of features, bias, transitions), until the gradient is CLOSE to 0."""
    total, n_features, step = weight.sum(), len(theta) - 5, live[:, 1:]
    seen = np.array([[(((y[:, :-1] == i) & (y[:, 1:] == j) & step).sum(axis=1) * weight).sum() for j in (0, 1)] for i in (0, 1)])
    theta = theta.copy()
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        p, pairs = _posteriors(_emissions(theta, live, cell, number), live, theta[n_features + 1 :].reshape(2, 2), weight)
        miss = np.where(live, y - p, 0.0) * weight[:, None]
        g = np.concatenate([np.bincount(number, miss.ravel()[cell], n_features), [miss.sum()], (seen - pairs).ravel()]) / total
        g -= DECAY * theta
        if np.abs(g).max() < CLOSE:
            break
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta += RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return theta


def _posteriors(e: np.ndarray, live: np.ndarray, trans: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of label 1 in equally long sequences, and expected transition counts, by scaled forward-backward."""
    n, length = e.shape
    weight = np.ones(n) if weight is None else weight
    a = np.exp(trans - trans.max())
    x = np.exp(np.clip(e, -30, 30))
    forward, backward = np.empty((length, n, 2)), np.empty((length, n, 2))
    f = np.stack([np.ones(n), x[:, 0]], 1)
    forward[0] = f / f.sum(1, keepdims=True)
    for t in range(1, length):
        f = forward[t - 1] @ a
        f[:, 1] *= x[:, t]
        f = np.where(live[:, t, None], f, forward[t - 1])
        forward[t] = f / f.sum(1, keepdims=True)
    backward[-1] = 0.5
    pairs = np.zeros((2, 2))
    for t in range(length - 2, -1, -1):
        b = backward[t + 1] * np.stack([np.ones(n), x[:, t + 1]], 1)
        both = forward[t][:, :, None] * a * b[:, None, :]
        on = live[:, t + 1]
        pairs += (both[on] * (weight[on, None, None] / both[on].sum((1, 2), keepdims=True))).sum(0)
        b = np.where(on[:, None], b @ a.T, backward[t + 1])
        backward[t] = b / b.sum(1, keepdims=True)
    both = forward * backward
    return (both[:, :, 1] / both.sum(2)).T, pairs


def calibrate(evidence: np.ndarray, toxic: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """(slope, offset) on the evidence's log odds, by Newton's method with a small ridge; the slope is positive."""
    x = np.stack([log_odds(evidence), np.ones(len(evidence))], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        g = x.T @ (toxic - p) - ridge * (theta - [1.0, 0.0])
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        theta = theta + np.clip(np.linalg.solve(h, g), -1, 1)
    return (float(theta[0]), float(theta[1])) if theta[0] > 0.05 else (1.0, 0.0)


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p) - np.log1p(-p)


def train(documents: DataFrame, labels: DataFrame) -> dict:
    """The model of ``documents(doc_id, text)`` as ``labels(doc_id, toxic)`` marks them; without toxic rows, one that finds none. A document with
    several labels is toxic if one of them says so; null labels say nothing."""
    spark = documents.sparkSession
    by = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    sample = by.filter("toxic = 1").orderBy(*order).limit(TOXIC_ROWS).unionByName(by.filter("toxic = 0").orderBy(*order).limit(CLEAN_ROWS))
    rows = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic")
    rows = store.materialize(rows.repartition(2 * spark.sparkContext.defaultParallelism), "sample")
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    empty = {"lexicon": np.zeros(0, np.uint64), "weights": np.zeros(0), "bias": -9.0, "trans": np.zeros((2, 2)), "curve": None}
    if not n.get(1) or not n.get(0):
        return empty
    counts = rows.mapInArrow(_document_features, "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    t, c, share = F.col("t"), F.col("c"), n[1] / (n[0] + n[1])
    part = lambda x, q: F.when(x > 0, x * F.log(x / ((t + c) * q))).otherwise(0.0)
    counts = counts.filter("feature <> 0 and t >= 3").withColumn("ratio", 2 * (part(t, share) + part(c, 1 - share))).withColumn("sure", (t / n[1]) / (t / n[1] + c / n[0]))
    found = counts.filter((F.col("ratio") >= RATIO) & (F.col("sure") > LIKELY)).select("feature", "sure").toArrow()
    if not found.num_rows:
        return empty
    lexicon = found.column("feature").to_numpy().view(np.uint64)
    i = np.argsort(lexicon)
    lexicon, sure = lexicon[i], found.column("sure").to_numpy()[i] >= SURE
    windows = rows.mapInArrow(_windows(lexicon, sure), "doc long, toxic boolean, size int, weight double, places array<int>, numbers array<int>, labelled array<int>").toArrow()
    windows = windows.sort_by([("size", "ascending"), ("doc", "ascending")])
    weights, bias, trans = fit(windows, len(lexicon))
    model = {"lexicon": lexicon, "weights": weights, "bias": bias, "trans": trans, "curve": None}
    found = rows.mapInArrow(_evidence(model), "evidence double, toxic int").toArrow()
    return model | {"curve": calibrate(found.column("evidence").to_numpy(), found.column("toxic").to_numpy())}


def _evidence(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(tagger.tag(batch.column(0))[0]), batch.column(1).cast(pa.int32())], ["evidence", "toxic"])

    return run


class Tagger:
    def __init__(self, model: dict):
        self.table = HashTable(max(4, int(np.ceil(np.log2(2 * len(model["lexicon"]) + 2)))))
        self.table.add(model["lexicon"], np.arange(len(model["lexicon"]), dtype=np.int32))
        self.weights = np.append(model["weights"], 0.0)
        self.bias, self.curve = model["bias"], model["curve"]
        self.a = np.exp(model["trans"] - model["trans"].max())
        # (a, then a neutral word) as a matrix, by its eigenvectors; both values are real as all entries are positive
        step = self.a @ np.diag([1.0, np.exp(self.bias)])
        values, self.v = np.linalg.eig(step)
        self.inverse, self.fade = np.linalg.inv(self.v), values / np.abs(values).max()
        self.neutral = np.array([1.0, np.exp(self.bias)])
        self._fresh()

    def _fresh(self) -> None:
        self.cache, self.scores = HashTable(16), np.zeros(0)

    def emissions(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each word the weight of its lexicon features, NaN if it has none."""
        h = word_hashes(data, starts, ends)
        at = self.cache.find(h)
        new = np.flatnonzero(at < 0)
        if len(new):
            keys, one = np.unique(h[new], return_index=True)
            f = features(data, starts[new[one]], ends[new[one]])
            number = np.where(f == 0, -1, self.table.find(f.ravel()).reshape(f.shape))
            score = np.where((number >= 0).any(axis=1), self.weights[number].sum(axis=1), np.nan)
            if self.cache.n + len(keys) > CACHE:
                self._fresh()
                at = np.full(len(h), -1, np.int32)
                keys_all, one_all = np.unique(h, return_index=True)
                f = features(data, starts[one_all], ends[one_all])
                number = np.where(f == 0, -1, self.table.find(f.ravel()).reshape(f.shape))
                keys, score = keys_all, np.where((number >= 0).any(axis=1), self.weights[number].sum(axis=1), np.nan)
            self.cache.add(keys, np.arange(len(keys), dtype=np.int32) + len(self.scores))
            self.scores = np.concatenate([self.scores, score])
            at = self.cache.find(h)
        return self.scores[at]

    def _run(self, x: np.ndarray, n: np.ndarray, back: bool) -> np.ndarray:
        """Row vectors x after n neutral words (back: column vectors, before them), up to a factor."""
        power = self.fade ** n[:, None]
        out = ((x @ self.inverse.T) * power) @ self.v.T if back else ((x @ self.v) * power) @ self.inverse
        return np.maximum(out, 1e-300)

    def marginals(self, doc: np.ndarray, place: np.ndarray, weight: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Chance of label 1 for lexicon words, given their documents (ascending), word numbers in these and weights, and the documents' sizes."""
        ids, begin, count = np.unique(doc, return_index=True, return_counts=True)
        x = np.stack([np.ones(len(weight)), np.exp(np.clip(self.bias + weight, -30, 30))], 1)
        forward, backward = np.empty_like(x), np.empty_like(x)
        on = np.argsort(-count, kind="stable")
        begin, count, last = begin[on], count[on], sizes[ids][on] - 1
        for k in range(count[0] if len(count) else 0):
            m = int(np.searchsorted(-count, -k, side="left"))
            at = begin[:m] + k
            if k == 0:
                lead = place[at] > 0
                f = np.ones((m, 2))
                if lead.any():
                    f[lead] = self._run(np.repeat(self.neutral[None], lead.sum(), 0), place[at][lead] - 1, False) @ self.a
            else:
                f = self._run(forward[at - 1], place[at] - place[at - 1] - 1, False) @ self.a
            f = f * x[at]
            forward[at] = f / f.sum(1, keepdims=True)
        for k in range((count[0] if len(count) else 0) - 1, -1, -1):
            m = int(np.searchsorted(-count, -k, side="left"))
            at, end = begin[:m] + k, count[:m] == k + 1
            b = np.empty((m, 2))
            b[end] = self._run(np.ones((end.sum(), 2)), last[:m][end] - place[at][end], True)
            go = ~end
            nxt = at[go] + 1
            b[go] = self._run((backward[nxt] * x[nxt]) @ self.a.T, place[nxt] - place[at[go]] - 1, True)
            backward[at] = b / b.sum(1, keepdims=True)
        both = forward * backward
        return both[:, 1] / both.sum(1)

    def tag(self, texts: pa.Array) -> tuple[np.ndarray, list[list[dict]]]:
        """(score of each text, its offending spans: start, end in characters, and their words' greatest chance)."""
        scores, spans = [], []
        for lo, hi, data, offsets in text_chunks(texts, 1 << 19):
            starts, ends, first = word_spans(data, offsets)
            weight = self.emissions(data, starts, ends) if len(starts) else np.zeros(0)
            held = np.flatnonzero(~np.isnan(weight))
            doc = np.searchsorted(first, held, side="right") - 1
            p = self.marginals(doc, held - first[doc], weight[held], np.diff(first))
            clean = np.zeros(hi - lo)
            np.add.at(clean, doc, np.log1p(-np.minimum(p, 1 - 1e-9)))
            scores.append(-np.expm1(clean))
            mine: list[list[dict]] = [[] for _ in range(hi - lo)]
            before = -2
            flagged = p >= 0.5
            lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)]) if flagged.any() else None
            for w, d, q in zip(held[flagged].tolist(), doc[flagged].tolist(), p[flagged].tolist()):
                start, end = (int(lead[k] - lead[offsets[d]]) for k in (starts[w], ends[w]))
                if before == w - 1 and mine[d]:
                    mine[d][-1].update(end=end, p=max(mine[d][-1]["p"], float(q)))
                else:
                    mine[d].append({"start": start, "end": end, "p": float(q)})
                before = w
            spans += mine
        score = np.abs(np.concatenate(scores)) if scores else np.zeros(0)
        if self.curve:
            score = 1 / (1 + np.exp(-np.clip(self.curve[0] * log_odds(score) + self.curve[1], -30, 30)))
        return score, spans


_taggers: dict = {}


def _tagger(sent) -> Tagger:
    """One for each worker process and model."""
    if _taggers.get("of") is not sent.value:
        _taggers.update(of=sent.value, tagger=Tagger(sent.value))
    return _taggers["tagger"]


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))


def tag(documents: DataFrame, model: dict) -> DataFrame:
    """doc_id, score (0 to 1; about 0 without lexicon words, as for null and empty texts) and spans for each row of ``documents(doc_id, text)``: repeated
    rows, and rows of one doc_id with other texts, are scored each by its own text. Other columns are ignored."""
    store.small_batches(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, spans = _tagger(sent).tag(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(spans, SPANS)], ["doc_id", "score", "spans"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, spans array<struct<start:int, end:int, p:double>>")


def clean(documents: DataFrame, model: dict) -> DataFrame:
    """The rows of ``documents`` whose text scores below 0.5, all columns unchanged."""
    store.small_batches(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, _ = _tagger(sent).tag(batch.column(at))
            yield batch.filter(pa.array(score < 0.5))

    return documents.mapInArrow(run, documents.schema)


def held_out() -> "F.Column":
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out())
    tagged = tag(documents, train(documents, labels))
    return tagged.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
