"""ZIP archives as tables: a Python data source that reads an archive's directory on the driver, in pieces, and its members in tasks.

An archive is one file, or ranges of several: the first so many bytes of each, in order, as a resumed download leaves them. Ranges are read where they lie, and never joined. The driver
follows the directory record by record and keeps only where each partition's records begin; a partition's task reads these records, then their members, and checks each
one's size and CRC-32. Paths are URIs of file systems that driver and executors reach through Arrow.
"""

from __future__ import annotations

import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.contracts import ContractError

MEMBERS = "archive string, name string, size long, content binary"
PIECE = 1 << 20
PART = 64 << 20  # bytes of members in one partition
LINK = 0o120000


class Ranges:
    """The bytes of an archive, over parts (uri, bytes of it, or null for all)."""

    def __init__(self, parts: list):
        from pyarrow import fs

        self.files, self.ends, total = [], [], 0
        for uri, n in parts:
            system, path = fs.FileSystem.from_uri(uri)
            info = system.get_file_info(path)
            if info.type != fs.FileType.File:
                raise ContractError(f"{uri} is no file")
            if n is not None and not 0 < n <= info.size:
                raise ContractError(f"{uri} holds {info.size} bytes, not {n}")
            total += info.size if n is None else n
            self.files.append((system, path))
            self.ends.append(total)
        self.size, self.open = total, {}

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or at + n > self.size:
            raise ContractError(f"bytes {at} to {at + n} are beyond an archive of {self.size}")
        out = []
        for k, end in enumerate(self.ends):
            begin = self.ends[k - 1] if k else 0
            if n and at < end:
                if k not in self.open:
                    self.open[k] = self.files[k][0].open_input_file(self.files[k][1])
                take = min(n, end - at)
                self.open[k].seek(at - begin)
                out.append(self.open[k].read(take))
                at, n = at + take, n - take
        return b"".join(out)


@dataclass
class Member:
    name: str
    method: int
    crc: int
    packed: int
    size: int
    mode: int
    at: int
    encrypted: bool


def directory(ranges: Ranges) -> tuple[int, int, int]:
    """(where the directory begins, its bytes, its records), of plain and of 64-bit archives."""
    tail = ranges.read(max(0, ranges.size - 65_557), min(ranges.size, 65_557))
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ContractError("not a ZIP archive")
    records, size, at = struct.unpack_from("<HII", tail, end + 10)
    if records == 0xFFFF or size == 0xFFFFFFFF or at == 0xFFFFFFFF:
        where = struct.unpack_from("<Q", ranges.read(ranges.size - len(tail) + end - 20, 20), 8)[0]
        records, size, at = struct.unpack_from("<QQQ", ranges.read(where, 56), 32)
    return at, size, records


def _long_fields(extra: bytes, short: list[int]) -> list[int]:
    """Sizes and place that don't fit into 32 bits stand in a field of their own, in this order."""
    at, out = 0, list(short)
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            values = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            out = [next(values) if x == 0xFFFFFFFF else x for x in short]
        at += 4 + n
    return out


def records(ranges: Ranges, at: int, stop: int, n: int) -> Iterator[tuple[int, Member]]:
    """(where it begins, record) of the next ``n`` records of a directory, read in pieces."""
    held, begin = b"", at
    for _ in range(n):
        need = 46
        while True:
            if len(held) - (at - begin) < need:
                held, begin = ranges.read(at, min(max(PIECE, need), stop - at)), at
            i = at - begin
            if len(held) - i < need or held[i : i + 4] != b"PK\x01\x02":
                raise ContractError("the archive's directory is damaged")
            flags, method, _, crc, packed, size, a, b, c = struct.unpack_from("<HHIIIIHHH", held, i + 8)
            if need == (need := 46 + a + b + c):
                break
        mode, place = struct.unpack_from("<II", held, i + 38)
        size, packed, place = _long_fields(held[i + 46 + a : i + 46 + a + b], [size, packed, place])
        name = held[i + 46 : i + 46 + a].decode("utf-8" if flags & 0x800 else "cp437")
        yield at, Member(name, method, crc, packed, size, mode >> 16, place, bool(flags & 1))
        at += need


def fault(m: Member) -> str | None:
    """What is wrong with a member that shall become a file below some folder, if anything is."""
    steps = re.split(r"[/\\]", m.name)
    if steps[0] == "" or re.match(r"[A-Za-z]:", m.name):
        return "an absolute path"
    if ".." in steps:
        return "a path that climbs"
    if m.mode & 0o170000 == LINK:
        return "a link"
    return "encrypted" if m.encrypted else None


def content(ranges: Ranges, m: Member) -> bytes:
    a, b = struct.unpack_from("<HH", ranges.read(m.at, 30), 26)
    data = ranges.read(m.at + 30 + a + b, m.packed)
    if m.method == zipfile.ZIP_DEFLATED:
        unpacker = zlib.decompressobj(-15)
        data = unpacker.decompress(data, m.size + 1)  # a bomb stops at the size that it claims
    elif m.method != zipfile.ZIP_STORED:
        raise ContractError(f"{m.name} is packed in another way ({m.method})")
    if len(data) != m.size or zlib.crc32(data) != m.crc:
        raise ContractError(f"{m.name} is damaged")
    return data


class Members(InputPartition):
    def __init__(self, archive: int, at: int, stop: int, n: int):
        super().__init__(archive)
        self.archive, self.at, self.stop, self.n = archive, at, stop, n


class MemberReader(DataSourceReader):
    def __init__(self, options: dict):
        self.archives = json.loads(options["archives"])
        self.glob, self.only = options.get("glob", "*"), options.get("only")
        self.part = int(options.get("part", PART))
        self.most_files, self.most_bytes = int(options.get("most_files", 1 << 40)), int(options.get("most_bytes", 1 << 60))

    def _wanted(self, m: Member) -> bool:
        return not m.name.endswith("/") and fnmatchcase(m.name, self.glob)

    def partitions(self) -> list[Members]:
        """Follows each directory once: counts, refuses what must not be unpacked before anything is read, and cuts it by the bytes of its members."""
        out, files, size = [], 0, 0
        for k, parts in enumerate(self.archives):
            ranges = Ranges(parts)
            first, length, n = directory(ranges)
            begin, held, count = first, 0, 0
            for at, m in records(ranges, first, first + length, n):
                if held > self.part:
                    out.append(Members(k, begin, first + length, count))
                    begin, held, count = at, 0, 0
                count += 1
                if not m.name.endswith("/"):
                    files, size = files + 1, size + m.size
                    wrong = fault(m) or (f"not {self.only}" if self.only and not fnmatchcase(m.name.lower(), self.only) else None)
                    if wrong:
                        raise ContractError(f"member {m.name}: {wrong}")
                if files > self.most_files or size > self.most_bytes:
                    raise ContractError("the archive is too large")
                held += m.packed if self._wanted(m) else 0
            if count:
                out.append(Members(k, begin, first + length, count))
        return out or [Members(-1, 0, 0, 0)]

    def read(self, partition: Members) -> Iterator[tuple]:
        if partition.n:
            parts = self.archives[partition.archive]
            ranges = Ranges(parts)
            for _, m in records(ranges, partition.at, partition.stop, partition.n):
                if self._wanted(m):
                    yield parts[0][0], m.name, m.size, content(ranges, m)


class MemberSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> MemberReader:
        return MemberReader(dict(self.options))


def read_members(spark: SparkSession, archives: list, glob: str = "*", only: str | None = None, most_files: int | None = None, most_bytes: int | None = None, part: int = PART) -> DataFrame:
    """(archive, name, size, content) of the members whose names fit ``glob``. An archive is a URI, or a list of (uri, bytes) ranges; (uri, None) is a whole file. Absolute and climbing paths, links,
    encrypted members, names that don't fit ``only`` (in lower case), and more files or bytes than allowed raise before a member is read, and a damaged member
    where it is read. A partition has members of some ``part`` packed bytes; one is held whole by its task."""
    spark.dataSource.register(MemberSource)
    options = {"archives": json.dumps([[[a, None]] if isinstance(a, str) else [list(p) for p in a] for a in archives]), "glob": glob}
    options |= {k: str(v) for k, v in {"only": only, "most_files": most_files, "most_bytes": most_bytes, "part": part}.items() if v is not None}
    return spark.read.format("zip_members").options(**options).load()


def checked_ranges(parts: list, expected: int) -> list:
    """The ranges of one archive, whose bytes must be as many as expected."""
    total = sum(n for _, n in parts)
    if not parts or total != expected:
        raise ContractError(f"the ranges hold {total} bytes, not {expected}")
    return [tuple(p) for p in parts]


def write_archives(df: DataFrame, folder: str, compress: bool = True) -> DataFrame:
    """Packs ``df(name, content)`` into archives below a folder that executors share, one for each partition with rows; returns (path, size, members). Each is renamed when whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        path, members = f"{base}/{uuid.uuid4().hex}.zip", 0
        archive = sink = None
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if archive is None:
                    system.create_dir(base, recursive=True)
                    sink = system.open_output_stream(f"{path}.part")
                    archive = zipfile.ZipFile(_Unseekable(sink), "w", zipfile.ZIP_DEFLATED if compress else zipfile.ZIP_STORED)
                archive.writestr(name, data.as_py())
                members += 1
        if archive is not None:
            archive.close()
            sink.close()
            system.move(f"{path}.part", path)
            size = system.get_file_info(path).size
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path.rpartition('/')[2]}"]), pa.array([size], pa.int64()), pa.array([members], pa.int64())], ["path", "size", "members"])

    packed = df.select("name", F.col("content").cast("binary").alias("content"))
    return packed.mapInArrow(run, "path string, size long, members long")


class _Unseekable(io.RawIOBase):
    """A stream that only goes forward, as stores of objects have them."""

    def __init__(self, sink):
        self.sink = sink

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.sink.write(bytes(data))
        return len(data)

    def flush(self) -> None:
        if not self.sink.closed:
            self.sink.flush()
