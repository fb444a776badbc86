"""Byte-level BPE encoding and decoding by a rank file, with the tokenizers library.

A rank file merges any two neighbours whose joined bytes have a rank, least rank first. The library merges listed pairs, least
place first; so every split of a ranked token into two ranked tokens is listed, in the order of the joined token's rank, and
a piece that is a token itself is taken whole. Encoding goes over whole Arrow batches (see ``pieces``); decoding looks every
id's bytes up and joins them, so characters that are split between tokens come back whole.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import store
from .kernels import ragged
from .pieces import PATTERN, Encoder, as_characters, byte_characters

_codecs: dict[tuple, "Codec"] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Codec:
    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import models

        ranks = read_ranks(path)
        chars = byte_characters()
        shown = {token: "".join(chars[b] for b in token) for token in ranks}
        merges = [(shown[t[:i]], shown[t[i:]]) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        tokenize = models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True, cache_capacity=0).tokenize
        split = regex.compile(pattern)
        piece = lambda p: [t.id for t in tokenize(as_characters(p))]
        self.encoder = Encoder(piece, lambda text: [i for m in split.finditer(text) for i in piece(m.group())], pattern == PATTERN)
        size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.length = np.array([len(t) for t in self.tokens], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        width = len(str(size)) + 1
        self.decimals = np.array([list(f"{i},".encode().ljust(width, b"\0")) for i in range(size)], np.uint8)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that the ids stand for."""
        return self.bytes[ragged(self.begin[ids], self.length[ids])]

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as ids arrive: bytes of a split character wait for its last one; bytes that form no character become U+FFFD."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if text := decoder.decode(self.tokens[i]):
                yield text
        if text := decoder.decode(b"", True):
            yield text

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character of each id and the one after its last, in code points of ``text``; a character that is split between
        ids belongs to each of them."""
        raw = np.frombuffer(text.encode(), np.uint8)
        number = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.length[ids])
        return number[ends - self.length[ids]], number[ends - 1] + 1

    def decimal_text(self, ids: np.ndarray) -> np.ndarray:
        rows = self.decimals[ids]
        return rows[rows != 0]


def codec(path: str, pattern: str) -> Codec:
    """One for each worker process."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(documents: DataFrame, path: str, pattern: str, offsets: bool = False) -> DataFrame:
    """doc_id, ids, n_tokens, the digests of ids and of the bytes that they decode to; with ``offsets`` also the characters'
    ``starts`` and ``ends`` of each id. One row for each row of ``documents(doc_id, text)``, in any number of repeats; null is the empty text, an empty table gives no rows, other columns aren't read. A text is held
    whole. A pattern other than ``pieces.PATTERN`` goes through the regex library for all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for a, b, ids, counts in own.encoder.encode(batch.column(1)):
                stop = np.concatenate([[0], np.cumsum(counts)])
                text = own.decimal_text(ids)
                commas = np.concatenate([[0], np.flatnonzero(text == 44) + 1])[stop]
                raw = own.decode(ids)
                ends = np.concatenate([[0], np.cumsum(own.length[ids])])[stop]
                text, raw = memoryview(text), memoryview(raw)
                shas = [hashlib.sha256(text[i : max(i, j - 1)]).hexdigest() for i, j in zip(commas[:-1].tolist(), commas[1:].tolist())]
                back = [hashlib.sha256(raw[i:j]).hexdigest() for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
                columns = {"doc_id": batch.column(0).slice(a, b - a), "n_tokens": pa.array(counts), "ids_sha256": pa.array(shas, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
                lists = {"ids": ids}
                if offsets:
                    spans = [own.offsets(t or "", ids[i:j]) for t, i, j in zip(batch.column(1).slice(a, b - a).to_pylist(), stop[:-1], stop[1:])]
                    lists |= {"starts": np.concatenate([s for s, _ in spans]), "ends": np.concatenate([e for _, e in spans])}
                for name, values in lists.items():
                    columns[name] = pa.ListArray.from_arrays(pa.array(stop.astype(np.int32)), pa.array(values.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(columns)

    store.small_batches(documents.sparkSession)
    shape = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>" + ", starts array<int>, ends array<int>" * offsets
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, shape)


def multilingual() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), *multilingual()).drop("ids")
