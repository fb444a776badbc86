"""Media columns as progressive JPEG.

``decode`` reads any progressive Huffman-coded JPEG of 8-bit samples with one or three components: scans of a spectral band at a
bit depth fill coefficient arrays (DC and AC, first and refining scans, end-of-band runs, restart intervals), which are then
dequantized, inverse-transformed in numpy, upsampled and turned to RGB. It steps symbol by symbol, but takes runs of one symbol,
and the correction bits of end-of-band runs, as arrays.

``store_bytes`` keeps a payload losslessly in the AC coefficients of a 4:2:0 image with quantizers of 1, one byte in each: bit 7 is
the sign and the others, with 128 added, the magnitude. So in a first scan, which leaves out the lowest bit, all coefficients have one
size and take one byte each, of a code and seven bits: the stored bytes still compress as the payload does.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import store

UNIT = 576
BLOCK = 63  # payload bytes
# Markers of the format
SOI, SOF2, DHT, SOS, EOI, DQT, DRI, COM, APP0 = 0xD8, 0xC2, 0xC4, 0xDA, 0xD9, 0xDB, 0xDD, 0xFE, 0xE0
#: Component (0 all), first and last coefficient, bit depth before and after: the order in which the scans are written.
SCANS = ((0, 0, 0, 0, 1), (1, 1, 5, 0, 1), (2, 1, 63, 0, 1), (3, 1, 63, 0, 1), (1, 6, 63, 0, 1), (0, 0, 0, 1, 0), (2, 1, 63, 1, 0), (3, 1, 63, 1, 0), (1, 1, 63, 1, 0))


@lru_cache(maxsize=1)
def zigzag() -> np.ndarray:
    """Row-major place of each coefficient in zigzag order."""
    return np.array(sorted(range(64), key=lambda i: (s := i // 8 + i % 8, i // 8 if s % 2 else i % 8)))


@lru_cache(maxsize=1)
def inverse_transform() -> np.ndarray:
    """(64, 64): coefficients in zigzag order, as a row vector, to samples in row-major order."""
    k, x = np.mgrid[0:8, 0:8]
    basis = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(0.125), 0.5)
    return np.kron(basis, basis)[zigzag()].astype(np.float32)


def huffman_table(lengths: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """(the DHT body after its class byte, symbol: (code, length)) of canonical codes."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    body = bytes(sum(lengths[s] == n for s in order) for n in range(1, 17)) + bytes(order)
    return body, _codes(body)


@lru_cache(maxsize=256)
def _codes(body: bytes) -> dict[int, tuple[int, int]]:
    out, code, at = {}, 0, 16
    for n in range(1, 17):
        for _ in range(body[n - 1]):
            out[body[at]] = (code, n)
            code, at = code + 1, at + 1
        code <<= 1
    return out


@lru_cache(maxsize=256)
def _table(body: bytes) -> dict[str, dict]:
    codes = _codes(body)
    return {"encode": codes, "decode": {v: k for k, v in codes.items()}}


def _bands(size: int) -> dict[int, int]:
    """Code lengths for coefficients of one size without zeros before them, and for end-of-band runs."""
    return {size: 1} | {n << 4: 5 for n in range(15)}


_DC_BODY, _DC = huffman_table({0: 1} | {n: 5 for n in range(1, 12)})
_AC_BODY, _AC = huffman_table(_bands(7))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _stuffed(bits: np.ndarray) -> bytes:
    """Bits as bytes, the last filled with ones, and a zero after each byte 255."""
    pad = -len(bits) % 8
    raw = np.packbits(np.concatenate([bits, np.ones(pad, np.uint8)]) if pad else bits)
    return raw.tobytes().replace(b"\xff", b"\xff\x00")


def _first_bits(magnitude: np.ndarray, negative: np.ndarray, size: int) -> np.ndarray:
    """Code 0 and ``size`` bits of each coefficient; negative ones have their bits turned."""
    value = magnitude ^ np.where(negative, (1 << size) - 1, 0).astype(np.uint8)
    return np.unpackbits((value & ((1 << size) - 1))[:, None], axis=1)[:, 7 - size :]


def _eob_runs(blocks: int) -> Iterator[tuple[int, int]]:
    """(number, exponent) of end-of-band runs over ``blocks`` blocks."""
    while blocks:
        n = min(blocks, 32767)
        yield n, n.bit_length() - 1
        blocks -= n


def _bit_list(value: int, n: int) -> list[int]:
    return [value >> (n - 1 - i) & 1 for i in range(n)]


def store_bytes(payload: bytes) -> bytes:
    """A progressive JPEG that holds ``payload``, with its length in a comment. Its sides are the most equal ones that leave at most a 64th unused."""
    mcus = max(1, -(-len(payload) // (6 * BLOCK)))
    high = next(h for h in range(int(np.sqrt(mcus)), 0, -1) if (h * -(-mcus // h) - mcus) * 64 <= mcus)
    high = max(high, -(-mcus // 4095))
    wide = -(-mcus // high)
    mcus = wide * high
    data = np.zeros(mcus * 6 * BLOCK, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    data = data.reshape(-1, BLOCK)
    planes = [data[: 4 * mcus], data[4 * mcus : 5 * mcus], data[5 * mcus :]]
    negative, magnitude = [p >> 7 for p in planes], [p & 127 | 128 for p in planes]
    out = [b"\xff\xd8", _segment(APP0, b"JFIF\0\1\2\0\0\1\0\1\0\0"), _segment(COM, b"payload %d" % len(payload)), _segment(DQT, b"\0" + b"\1" * 64)]
    out.append(_segment(SOF2, struct.pack(">BHHB", 8, high * 16, wide * 16, 3) + b"\1\x22\0\2\x11\0\3\x11\0"))
    out.append(_segment(DHT, b"\0" + _DC_BODY + b"\x10" + _AC_BODY))
    for component, first, last, high_bit, low in SCANS:
        parts = [1, 2, 3] if component == 0 else [component]
        out.append(_segment(SOS, bytes([len(parts)]) + b"".join(bytes([c, 0]) for c in parts) + bytes([first, last, high_bit << 4 | low])))
        if component == 0:
            bits = np.zeros(6 * mcus, np.uint8)  # differences of 0, or refining bits of 0
        elif high_bit == 0:
            at, size = slice(first - 1, last), 8 - low
            bits = _first_bits((magnitude[component - 1][:, at] >> low).ravel(), negative[component - 1][:, at].ravel(), size).ravel()
        else:
            bit = magnitude[component - 1] >> low & 1
            pieces, done = [], 0
            for n, k in _eob_runs(len(bit)):
                code, length = _AC[k << 4]
                pieces += [np.array(_bit_list(code, length) + _bit_list(n - (1 << k), k), np.uint8), bit[done : done + n].ravel()]
                done += n
            bits = np.concatenate(pieces)
        out.append(_stuffed(bits))
    return b"".join(out) + b"\xff\xd9"


class Bits:
    """The bits of one entropy-coded segment; ones follow its end."""

    def __init__(self, raw: bytes):
        self.raw = np.frombuffer(raw.replace(b"\xff\x00", b"\xff"), np.uint8)
        self.at, self.end = 0, 8 * len(self.raw)

    def peek(self, n: int) -> np.ndarray:
        a, b = self.at >> 3, (self.at + n + 7) >> 3
        return np.unpackbits(self.raw[a:b])[self.at & 7 :][:n]

    def take(self, n: int) -> np.ndarray:
        bits = self.peek(n)
        if len(bits) < n:
            raise ValueError("the scan ends early")
        self.at += n
        return bits

    def number(self, n: int) -> int:
        value = 0
        for _ in range(n):
            if self.at >= self.end:
                raise ValueError("the scan ends early")
            value = value << 1 | int(self.raw[self.at >> 3]) >> (7 - (self.at & 7)) & 1
            self.at += 1
        return value

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.number(1)
            if (code, n) in table:
                return table[code, n]
        raise ValueError("no such code")


def _extend(value: int, size: int) -> int:
    return value if size == 0 or value >> (size - 1) else value - (1 << size) + 1


def _run(bits: Bits, code: int, length: int, size: int, most: int, step: int = 4096) -> np.ndarray:
    """The values of the next symbols that all have this code, each with ``size`` bits, at most ``most``; looks ``step`` ahead, then ever further."""
    found, width = [], length + size
    own = np.array(_bit_list(code, length), np.uint8)
    while most > 0:
        n = min(step, most, (bits.end - bits.at) // width)
        if n == 0:
            break
        rows = bits.peek(n * width).reshape(n, width)
        same = rows[:, 0] == own[0] if length == 1 else (rows[:, :length] == own).all(axis=1)
        good = n if same.all() else int(same.argmin())
        if good:
            lead = rows[:good, length:]
            if size <= 8:
                value = np.packbits(lead, axis=1)[:, 0].astype(np.int32) >> (8 - size) if size else np.zeros(good, np.int32)
            else:
                value = lead @ (1 << np.arange(size - 1, -1, -1))
            found.append(np.where(value >> max(size - 1, 0) & 1, value, value - (1 << size) + 1) if size else value)
            bits.at += good * width
            most -= good
        if good < n:
            break
        step = min(step * 16, 1 << 16)
    return np.concatenate(found) if found else np.zeros(0, np.int32)


def _dc(bits: Bits, blocks: list[tuple[np.ndarray, np.ndarray, dict]], refine: bool, low: int) -> None:
    """A DC scan: for each component (coefficients, places of blocks, codes), the places an (units, blocks in a unit) array."""
    units, per = len(blocks[0][1]), [p.shape[1] for _, p, _ in blocks]
    if refine:
        bit = bits.take(units * sum(per)).reshape(units, -1).astype(np.int16) << low
        if not bit.any():
            return
        done = 0
        for (c, place, _), n in zip(blocks, per):
            c[place, 0] |= bit[:, done : done + n]
            done += n
        return
    last = [0] * len(blocks)
    order = [k for k, n in enumerate(per) for _ in range(n)]
    at = 0
    zero = {tuple(t["encode"].get(0, (None, 0))) for _, _, t in blocks}
    while at < units * len(order):
        if len(zero) == 1 and None not in next(iter(zero)):
            # differences of 0 leave the component's last value
            code, length = next(iter(zero))
            n = len(_run(bits, code, length, 0, units * len(order) - at))
            if n:
                flat = np.arange(at, at + n) if any(last) else None
                for k, (c, place, _) in enumerate(blocks):
                    if last[k]:
                        lead = sum(per[:k])
                        own = flat[(flat % len(order) >= lead) & (flat % len(order) < lead + per[k])]
                        c[place[own // len(order), own % len(order) - lead], 0] = last[k] << low
                at += n
                continue
        unit, within = divmod(at, len(order))
        k = order[within]
        c, place, table = blocks[k]
        size = bits.symbol(table["decode"])
        last[k] += _extend(bits.number(size), size)
        c[place[unit, within - sum(per[:k])], 0] = last[k] << low
        at += 1


def _rows(place: np.ndarray, b: int, n: int) -> slice | np.ndarray:
    """Places b to b + n, as a slice where they are neighbours."""
    a, z = int(place[b]), int(place[b + n - 1])
    return slice(a, z + 1) if z - a == n - 1 else place[b : b + n]


def _ac_first(bits: Bits, c: np.ndarray, place: np.ndarray, table: dict, first: int, last: int, low: int) -> None:
    band = last - first + 1
    at, total = 0, len(place) * band
    lead, step = None, 4096
    while at < total:
        if lead is not None:
            size, (code, length) = lead
            value = _run(bits, code, length, size, total - at, step)
            step = 4096 if len(value) > 64 else 16
            head = min(-at % band, len(value))
            whole = (len(value) - head) // band
            for part, n in ((value[:head], 0), (value[head : head + whole * band], whole), (value[head + whole * band :], 0)):
                if n:
                    c[_rows(place, at // band, n), first : last + 1] = part.reshape(n, band) << low
                elif len(part):
                    c[place[at // band], first + at % band : first + at % band + len(part)] = part << low
                at += len(part)
            lead = None
            continue
        symbol = bits.symbol(table["decode"])
        run, size = symbol >> 4, symbol & 15
        if size:
            at += run
            c[place[at // band], first + at % band] = _extend(bits.number(size), size) << low
            at += 1
            if run == 0:
                lead = (size, table["encode"][symbol])
        elif run == 15:
            at += 16
        else:
            n = (1 << run) + bits.number(run)
            at = (at // band + n) * band


def _ac_refine(bits: Bits, c: np.ndarray, place: np.ndarray, table: dict, first: int, last: int, low: int) -> None:
    one = 1 << low

    def correct(rows: slice | np.ndarray, k: int) -> None:
        """Correction bits of all coefficients from k on that are known not to be 0."""
        part = c[rows, k : last + 1]
        known = part != 0
        if known.all():
            bit = bits.take(part.size).reshape(part.shape).astype(np.int16)
            c[rows, k : last + 1] = part + (bit << low) * ((part > 0) * np.int16(2) - np.int16(1))
            return
        bit = bits.take(int(known.sum())).astype(bool)
        values = part[known]
        values[bit] += np.where(values[bit] > 0, one, -one).astype(values.dtype)
        part[known] = values
        c[rows, k : last + 1] = part

    b = 0
    while b < len(place):
        k, row = first, c[place[b]]
        while k <= last:
            symbol = bits.symbol(table["decode"])
            run, size = symbol >> 4, symbol & 15
            if size == 0 and run < 15:
                n = (1 << run) + bits.number(run)
                if k > first:
                    correct(_rows(place, b, 1), k)
                    if n > 1:
                        correct(_rows(place, b + 1, n - 1), first)
                else:
                    correct(_rows(place, b, n), first)
                b += n - 1
                break
            new = (one if bits.number(1) else -one) if size else 0
            while k <= last:
                if row[k]:
                    if bits.number(1) and not abs(int(row[k])) & one:
                        row[k] += one if row[k] > 0 else -one
                elif run == 0:
                    row[k] = new
                    k += 1
                    break
                else:
                    run -= 1
                k += 1
            c[place[b]] = row
        b += 1


def coefficients(image: bytes) -> tuple[dict, list[np.ndarray]]:
    """(header, for each component an int16 array (block rows, block columns, 64) in zigzag order, not dequantized)."""
    raw = np.frombuffer(image, np.uint8)
    ff = np.flatnonzero(raw[:-1] == 255)
    follow = raw[ff + 1]
    stops = ff[(follow != 0) & (follow != 255)]
    head: dict = {"comments": [], "tables": {}, "quantizers": {}, "interval": 0}
    arrays: list[np.ndarray] = []
    at = 2
    if image[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    while at < len(image):
        marker = image[at + 1]
        if marker == EOI:
            break
        size = struct.unpack_from(">H", image, at + 2)[0]
        body = image[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == COM:
            head["comments"].append(body)
        elif marker == DRI:
            head["interval"] = struct.unpack(">H", body)[0]
        elif marker == DQT:
            while body:
                wide, number = body[0] >> 4, body[0] & 15
                n = 64 << wide
                head["quantizers"][number] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.float32)
                body = body[1 + n :]
        elif marker == DHT:
            while body:
                n = 17 + sum(body[1:17])
                head["tables"][body[0]] = _table(body[1:n])
                body = body[n:]
        elif marker == SOF2:
            _, high, wide, n = struct.unpack_from(">BHHB", body)
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            h, v = max(p[1] for p in parts), max(p[2] for p in parts)
            across, down = -(-wide // (8 * h)), -(-high // (8 * v))
            head |= {"size": (high, wide), "parts": parts, "units": (down, across)}
            arrays = [np.zeros((down * p[2] * across * p[1], 64), np.int16) for p in parts]
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise ValueError("not a progressive Huffman-coded JPEG")
        elif marker == SOS:
            at = _scan(image, at, stops, head, arrays, body)
    down, across = head["units"]
    return head, [c.reshape(down * p[2], across * p[1], 64) for c, p in zip(arrays, head["parts"])]


def _places(head: dict, i: int, several: bool) -> np.ndarray:
    """Where the blocks of component i stand, (units, blocks in a unit), in a scan of it alone or of several."""
    known = head.setdefault("places", {})
    if (i, several) not in known:
        down, across = head["units"]
        _, h, v, _ = head["parts"][i]
        grid = np.arange(down * v * across * h).reshape(down * v, across * h)
        if several:
            known[i, several] = grid.reshape(down, v, across, h).transpose(0, 2, 1, 3).reshape(down * across, v * h)
        else:
            most_h, most_v = max(p[1] for p in head["parts"]), max(p[2] for p in head["parts"])
            rows, columns = (-(-(-(-size * own // most)) // 8) for size, own, most in ((head["size"][0], v, most_v), (head["size"][1], h, most_h)))
            known[i, several] = grid[:rows, :columns].reshape(-1, 1)
    return known[i, several]


def _scan(image: bytes, at: int, stops: np.ndarray, head: dict, arrays: list[np.ndarray], body: bytes) -> int:
    """Reads one scan from ``at`` on; returns its end."""
    n = body[0]
    first, last, depth = body[1 + 2 * n : 4 + 2 * n]
    high, low = depth >> 4, depth & 15
    chosen = [(next(i for i, p in enumerate(head["parts"]) if p[0] == body[1 + 2 * i_]), body[2 + 2 * i_]) for i_ in range(n)]
    segments = []
    k = int(np.searchsorted(stops, at))
    while True:
        end = int(stops[k]) if k < len(stops) else len(image)
        segments.append(image[at:end])
        at = end
        if k >= len(stops) or not 0xD0 <= image[end + 1] <= 0xD7:
            break
        at, k = end + 2, k + 1
    places = [_places(head, i, n > 1) for i, _ in chosen]
    units = len(places[0])
    step = head["interval"] or units
    for s, segment in enumerate(segments):
        bits, own = Bits(segment), slice(s * step, (s + 1) * step)
        if first == 0:
            _dc(bits, [(arrays[i], p[own], head["tables"].get(t >> 4, {"encode": {}})) for (i, t), p in zip(chosen, places)], high > 0, low)
        else:
            (i, t), place = chosen[0], places[0][own, 0]
            (_ac_refine if high else _ac_first)(bits, arrays[i], place, head["tables"][0x10 | t & 15], first, last, low)
    return at


def decode(image: bytes) -> tuple[dict, list[np.ndarray], np.ndarray]:
    """(header, coefficient arrays, RGB tensor of uint8 (height, width, 3) at full resolution)."""
    head, arrays = coefficients(image)
    return head, arrays, render(head, arrays)


def render(head: dict, arrays: list[np.ndarray]) -> np.ndarray:
    high, wide = head["size"]
    h, v = max(p[1] for p in head["parts"]), max(p[2] for p in head["parts"])
    planes = []
    for c, (_, own_h, own_v, q) in zip(arrays, head["parts"]):
        x = c.reshape(-1, 64).astype(np.float32)
        quantizer = head["quantizers"][q]
        if (quantizer != 1).any():
            x *= quantizer
        x = x @ inverse_transform()
        x = np.rint(x + 128).clip(0, 255).astype(np.uint8)
        rows, columns = c.shape[:2]
        plane = x.reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8)
        if (own_h, own_v) != (h, v):
            plane = plane.repeat(v // own_v, axis=0).repeat(h // own_h, axis=1)
        planes.append(plane[:high, :wide])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2)
    y, cb, cr = planes[0].astype(np.float32), planes[1], planes[2]
    steps = np.arange(256, dtype=np.float32) - 128
    out = np.empty((high, wide, 3), np.uint8)
    for i, shift in enumerate((((1.402 * steps)[cr]), (-0.344136 * steps)[cb] - (0.714136 * steps)[cr], (1.772 * steps)[cb])):
        shift += y
        np.rint(shift, out=shift)
        np.clip(shift, 0, 255, out=shift)
        out[:, :, i] = shift
    return out


def load_bytes(head: dict, arrays: list[np.ndarray]) -> bytes:
    """The payload that ``store_bytes`` has put into these coefficients."""
    size = int(next(c for c in head["comments"] if c.startswith(b"payload ")).split()[1])
    parts = []
    for c in arrays:
        value = c.reshape(-1, 64)[:, 1:]
        parts.append(((np.abs(value) & 127) | np.where(value < 0, 128, 0)).astype(np.uint8).ravel())
    return np.concatenate(parts)[:size].tobytes()


def padded(text: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of UNIT."""
    return text + b"\xff" * (-len(text) % UNIT if text else UNIT)


def describe(rgb: np.ndarray) -> str:
    """Height, width, the sum of each channel, and an average hash: of 8 x 8 fields of the image (by whole pixels) which are brighter than their mean."""
    sums = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64)
    high, wide = rgb.shape[:2]
    # a tensor row is summed over columns first, so that no copy of the image is made
    across, down = (np.minimum(np.arange(8) * n // 8, n - 1) for n in (wide, high))
    fields = np.add.reduceat(np.add.reduceat(rgb.sum(axis=2, dtype=np.int32), across, axis=1), down, axis=0)
    size = np.outer(np.diff([*down, high]).clip(1), np.diff([*across, wide]).clip(1))
    mean = fields / size
    bits = np.packbits(mean.ravel() > mean.mean()).tobytes().hex()
    return f"{high}x{wide}:" + ",".join(map(str, sums.tolist())) + f":{bits}"


HELD = 4 << 20  # bytes of media or tensors of one batch
SHAPE = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
TENSOR = "height int, width int, rgb binary"


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    """The rows in batches of some HELD bytes by ``size(row)``; one row may be longer."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += size(row)
        if n >= HELD:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), schema.types)], schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), schema.types)], schema=schema)


def to_media(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of each row of ``documents(doc_id, text)``: its padded bytes as a progressive JPEG. Null is the empty text; a null
    doc_id stays null; repeated rows give equal rows; equal texts give equal bytes. Other columns are ignored."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = (text.as_py() or "").encode()
                yield doc_id, len(raw), store_bytes(padded(raw))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_batches(rows(batches), schema, lambda r: len(r[2]))

    store.small_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def unpack(media: DataFrame) -> DataFrame:
    """What the images of ``media(doc_id, n_bytes, media)`` hold: the payload's size and digests, a feature of the RGB tensor, and that tensor at
    full resolution: height, width and rgb, its bytes in row-major order. Null media give nulls; repeated rows equal rows; an empty table an empty one."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()),
        ("media_sha256", pa.string()), ("feature", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary()),
    ])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for doc_id, n_bytes, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                image = value.as_py()
                if image is None:
                    yield doc_id, n_bytes, *[None] * 9
                    continue
                head, arrays, rgb = decode(image)
                payload = load_bytes(head, arrays)
                digests = len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest()
                yield doc_id, n_bytes, *digests, describe(rgb), rgb.shape[0], rgb.shape[1], rgb.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_batches(rows(batches), schema, lambda r: len(r[10] or b"") + 256)

    store.small_batches(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"{SHAPE}, {TENSOR}")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The media column is written to the shared folder; all that follows comes from the stored bytes."""
    return unpack(store.materialize(to_media(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media", "zstd"))
