"""Array kernels over the bytes of Arrow string columns, shared by the text operators.

Words are the runs of ``[^\\x20\\x09-\\x0D]+``. Their hashes are 64-bit: a polynomial over random
byte values, evaluated for all words at once by one running sum, then mixed with the length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_CODE = _rng.integers(0, 2**63, 1 << 16, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C13 | 3  # 3 modulo 4, so that swapped neighbours never cancel
_BACK = pow(_BASE, -1, 2**64)
_powers = {}


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of MurmurHash3, for uint64 arrays."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        x = np.full(max(n, 1 << 16), base, np.uint64)
        x[0] = 1
        have = _powers[base] = np.multiply.accumulate(x)
    return have[:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each span; values are uint64 codes already drawn from a random table."""
    run = np.empty(len(values) + 1, np.uint64)
    run[0] = 0
    np.cumsum(values * _power(_BASE, len(values)), out=run[1:])
    h = (run[ends] - run[starts]) * _power(_BACK, len(values) + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * U64(0x9E3779B97F4A7C15))


def text_chunks(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of a string or binary column, ``size`` bytes at a time.

    Nulls are empty. One value longer than ``size`` makes a chunk of its own; values are never cut.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"" if kind == pa.large_binary() else "")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document and the total) for the words of concatenated documents."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = ~SPACE[data]
    full = offsets[:-1] < offsets[1:]
    before, after = np.empty_like(ink), np.empty_like(ink)
    before[0], before[1:] = False, ink[:-1]
    before[offsets[:-1][full]] = False
    after[-1], after[:-1] = False, ink[1:]
    after[offsets[1:][full] - 1] = False
    starts, ends = np.flatnonzero(ink & ~before), np.flatnonzero(ink & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    return span_hashes(_BYTE[LOWER[data] if lower else data], starts, ends)


class HashTable:
    """uint64 keys to int32 values: open addressing, probed for whole arrays at a time."""

    def __init__(self, bits: int = 12):
        self.n = 0
        self._clear(bits)

    def _clear(self, bits: int) -> None:
        self.bits, self.mask = bits, (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, -1, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where there is none."""
        at = self._slots(keys)
        out = self.values[at]
        left = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            v = self.values[at]
            out[left] = v
            on = (v >= 0) & (self.keys[at] != keys[left])
            left, at = left[on], at[on]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not in the table yet."""
        if (self.n + len(keys)) * 2 > len(self.keys):
            have = self.values >= 0
            keys, values = np.concatenate([self.keys[have], keys]), np.concatenate([self.values[have], values])
            self._clear(max(self.bits + 1, int(np.ceil(np.log2(len(keys) * 3)))))
            self.n = 0
        self.n += len(keys)
        at = self._slots(keys)
        while len(keys):
            free = self.values[at] < 0
            _, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            left = np.ones(len(keys), bool)
            left[put] = False
            keys, values, at = keys[left], values[left], (at[left] + 1) & self.mask


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every span, concatenated."""
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    if not total:
        return out
    full = lengths > 0
    s, n = starts[full], lengths[full]
    at = np.cumsum(n)[:-1]
    out[0] = s[0]
    out[at] = s[1:] - s[:-1] - n[:-1] + 1
    return np.cumsum(out)
