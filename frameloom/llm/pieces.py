"""Byte-level BPE over Arrow batches: texts are cut into pieces by array operations, and the tokenizers library encodes each
distinct piece once per worker process. The pieces' ids are then gathered for whole batches.

The cut is that of the pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

for texts whose code points all lie below ``PLAIN``; there Unicode's classes have not changed for long, so all libraries
agree. Other texts go through the regex library.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .kernels import _CODE, HashTable, ragged, span_hashes, text_chunks

PLAIN = 0x530
CACHE = 600_000
OTHER, LETTER, NUMBER, WHITE, BREAK = range(5)
# Unicode's White_Space below PLAIN
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0]
_CLASS = np.array([{"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(PLAIN)], np.uint8)
_CLASS[_WHITE] = WHITE


def byte_characters() -> list[str]:
    """The character that stands for each byte in the library's vocabularies: itself if printable, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


_MAP = dict(enumerate(byte_characters()))


def as_characters(piece: str) -> str:
    return piece.encode().decode("latin1").translate(_MAP)


def cut(codes: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """The starts of all pieces of code points below PLAIN; ``breaks`` are the places of separators, which are pieces too."""
    kind = _CLASS[codes]
    kind[breaks] = BREAK
    n = len(codes)
    start = np.empty(n, bool)
    start[0] = True
    start[1:] = kind[1:] != kind[:-1]
    start[breaks] = True
    begins = np.flatnonzero(start)
    white = begins[kind[begins] == WHITE]
    ends = np.append(begins[1:], n)[kind[begins] == WHITE]
    # a run of white space before text gives its last character up; a blank then leads the text's piece
    text = np.append(kind, BREAK)[ends] != BREAK
    last = ends[text] - 1
    start[last] = True
    blank = last[codes[last] == 0x20]
    start[blank + 1] = False
    # contractions: an apostrophe that leads a piece, with letters after it
    quote = np.flatnonzero((codes[:-1] == 0x27) & start[:-1] & (kind[:-1] == OTHER)) if n > 1 else white[:0]
    if len(quote):
        padded = np.append(codes, [0, 0]).astype(np.int64)
        a, b = padded[quote + 1], padded[quote + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        for at, size in ((quote[one], 2), (quote[two], 3)):
            start[at + 1] = False
            after = at + size
            inside = after[after < n]
            start[inside] |= kind[inside] == LETTER
    return np.flatnonzero(start)


class Encoder:
    """ids of texts; ``encode_piece`` gives those of one piece, ``encode_text`` those of a text that isn't plain, or of any where ``cuts`` is false: the cut above isn't this one's.
    Pieces are told apart by 64-bit hashes, CACHE of them at a time: over 10**13 new pieces one in some thousand workers meets a wrong one."""

    def __init__(self, encode_piece: Callable[[str], list[int]], encode_text: Callable[[str], list[int]], cuts: bool = True):
        self.encode_piece, self.encode_text, self.cuts = encode_piece, encode_text, cuts
        self._fresh()

    def _fresh(self) -> None:
        self.table = HashTable(16)
        self.begin, self.size, self.pool, self.used = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), np.zeros(1 << 16, np.int32), 0

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        ids = [self.encode_piece(p) for p in pieces]
        sizes = np.array([len(x) for x in ids], np.int32)
        flat = np.array([i for x in ids for i in x], np.int32)
        n = self.table.n
        while n + len(keys) > len(self.begin):
            self.begin, self.size = np.concatenate([self.begin, self.begin * 0]), np.concatenate([self.size, self.size * 0])
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, self.pool * 0])
        self.pool[self.used : self.used + len(flat)] = flat
        self.begin[n : n + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(keys)] = sizes
        self.used += len(flat)
        self.table.add(keys, np.arange(n, n + len(keys), dtype=np.int32))

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number in each document) of documents whose code points are all below PLAIN."""
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        at = lead[offsets]  # in characters
        text = data.tobytes().decode()
        bare = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        codes = np.zeros(len(bare) + n, np.uint32)
        breaks = at[1:] + np.arange(n)
        solid = np.ones(len(codes), bool)
        solid[breaks] = False
        codes[solid] = bare
        starts = cut(codes, breaks)
        ends = np.append(starts[1:], len(codes))
        first = np.searchsorted(starts, breaks)  # the separators' pieces
        real = np.ones(len(starts), bool)
        real[first] = False
        document = np.repeat(np.arange(n), np.diff(np.concatenate([[-1], first])) - 1)
        starts, ends = starts[real], ends[real]
        keys = span_hashes(_CODE[codes], starts, ends)
        found = self.table.find(keys)
        new = np.flatnonzero(found < 0)
        if len(new):
            if self.table.n + len(new) > CACHE:
                self._fresh()
                new = np.arange(len(keys))
            some, one = np.unique(keys[new], return_index=True)
            i = new[one]
            d = document[i]
            self._learn(some, [text[a:b] for a, b in zip((starts[i] - d).tolist(), (ends[i] - d).tolist())])
            found = self.table.find(keys)
        size = self.size[found].astype(np.int64)
        ids = self.pool[ragged(self.begin[found], size)]
        return ids, np.bincount(document, size, n).astype(np.int64)

    def encode(self, texts: pa.Array, chunk: int = 1 << 18):
        """Yields (first row, row after the last, ids, number of ids of each row). Null is empty."""
        for a, b, data, offsets in text_chunks(texts, chunk):
            if not self.cuts:
                out = [np.array(self.encode_text(data[i:j].tobytes().decode()), np.int32) for i, j in zip(offsets[:-1], offsets[1:])]
                yield a, b, np.concatenate(out), np.array([len(x) for x in out], np.int64)
                continue
            # the lead bytes of code points up to PLAIN are below 0xD5
            odd = np.flatnonzero(data >= 0xD4)
            if not len(odd):
                yield a, b, *self._plain(data, offsets)
                continue
            rough = np.zeros(b - a, bool)
            rough[np.searchsorted(offsets, odd, side="right") - 1] = True
            keep = ~rough
            n = np.diff(offsets)
            inner = np.concatenate([[0], np.cumsum(n[keep])])
            ids, counts = self._plain(data[np.repeat(keep, n)], inner)
            each = np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else []
            plain = iter(each)
            out = [next(plain) if k else np.array(self.encode_text(data[offsets[i] : offsets[i + 1]].tobytes().decode()), np.int32) for i, k in enumerate(keep)]
            yield a, b, np.concatenate(out), np.array([len(x) for x in out], np.int64)


PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # that of the cut above
_encoders: dict[str, Encoder] = {}


def _cuts_alike(settings: dict) -> bool:
    """Whether a file of the tokenizers library asks for this cut, and for nothing before it."""
    before, model = settings.get("pre_tokenizer") or {}, settings["model"]
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    return plain and settings.get("normalizer") is None and model.get("type") == "BPE" and not model.get("dropout") and all(t["special"] for t in settings.get("added_tokens", ()))


def library_encoder(path: str) -> Encoder:
    """For a file in the tokenizers library's own format; strings of special tokens are ordinary text, as the vocabulary's description asks. A file with another cut, a normalizer or
    added tokens that aren't special goes through the library text by text."""
    if path not in _encoders:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        whole.encode_special_tokens = True
        tokenize = whole.model.tokenize
        cuts = _cuts_alike(json.loads(whole.to_str()))
        _encoders[path] = Encoder(lambda p: [t.id for t in tokenize(as_characters(p))], lambda t: whole.encode(t, add_special_tokens=False).ids, cuts)
    return _encoders[path]
