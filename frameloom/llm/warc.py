"""Dictionary-compressed WARC archives.

An archive starts with a skippable frame that holds a Zstandard dictionary, trained on the archive's first ``SAMPLE_BYTES`` of records; after
it, each record is a frame of its own, compressed with that dictionary, so any record can be read by its offset alone. Zstandard can't
train on a handful of records: an archive of fewer than ``SAMPLE_LEAST``, or of records too alike or too small to train on, has their
content itself as its dictionary. Records with equal payloads are written once: the smallest page_id is the response, the others
revisit it.

A task writes archives of some ``ARCHIVE_BYTES``, each under a name of its own, and renames it when whole; a repeated task replaces them
with the same content. A record is held whole, as is its payload when it is read; nothing else is.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import store
from .skew import meet

# The skippable frame that holds a dictionary, and the frame magic of Zstandard
DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
DICTIONARY_BYTES = 1 << 16
SAMPLE_BYTES, SAMPLE_LEAST = 2 << 20, 16
LEVEL = 3
ARCHIVE_BYTES = 1 << 30
DATE = "2026-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:nopage:{payload_digest}>"


def record(page_id: int | None, url: str | None, payload: bytes | None, length: int, payload_digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit of the page ``refers_to``, whose block is the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, payload_digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        # white space and controls can't stand in a header field
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest}")
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to, payload_digest)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; of few or small samples, their content itself serves as one."""
    import zstandard

    try:
        if len(samples) >= SAMPLE_LEAST:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        pass
    return b"".join(samples)[-DICTIONARY_BYTES:]


class Writer:
    """Writes records to a stream; the first ones wait until there are enough to build the dictionary."""

    def __init__(self, sink):
        self.sink, self.waiting, self.held, self.compress, self.at, self.placed = sink, [], 0, None, 0, []

    def write(self, raw: bytes) -> None:
        if self.compress is None:
            self.waiting.append(raw)
            self.held += len(raw)
            if self.held >= SAMPLE_BYTES:
                self._start()
        else:
            self._put(self.compress(raw))

    def _start(self) -> None:
        import zstandard

        words = build_dictionary(self.waiting)
        frame = zstandard.ZstdCompressor(level=LEVEL).compress(words)
        self.sink.write(struct.pack("<II", DICTIONARY_MAGIC, len(frame)) + frame)
        self.at = 8 + len(frame)
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(words), write_content_size=True).compress
        for raw in self.waiting:
            self._put(self.compress(raw))
        self.waiting = []

    def _put(self, frame: bytes) -> None:
        self.placed.append((self.at, len(frame)))
        self.at += len(frame)
        self.sink.write(frame)

    def take_placed(self) -> list[tuple[int, int]]:
        """(offset, length) of the records that were written since the last call."""
        out, self.placed = self.placed, []
        return out

    def close(self) -> None:
        if self.compress is None:
            self._start()


def _decompressor(source):
    import zstandard

    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive doesn't start with a dictionary")
    frame = source.read(size)
    words = zstandard.ZstdDecompressor().decompress(frame) if frame[:4] == ZSTD_MAGIC else frame
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))


def read_archive(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record, in turn; the archive is never held whole."""
    stream = io.BufferedReader(_decompressor(source).stream_reader(source, read_across_frames=True, closefd=False), 1 << 16)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        fields = {}
        while line := stream.readline().rstrip(b"\r\n"):
            name, _, value = line.partition(b":")
            fields[name.decode().lower()] = value.strip().decode()
        block = stream.read(int(fields["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record's end is missing")
        yield fields, block


def read_record(uri: str, offset: int, length: int) -> bytes:
    """One record's bytes, from its own frame and the archive's dictionary."""
    fs, path = store.open_fs(uri)
    with fs.open_input_file(path) as source:
        decompress = _decompressor(source).decompress
        source.seek(offset)
        return decompress(source.read(length))


INDEX = "file string, offset long, length long"


def write(pages: DataFrame, out: str) -> DataFrame:
    """Writes ``pages(page_id, url, html)`` below the URI ``out``, archives for each partition; returns their index, (file, offset, length) of each record.

    A null html is an empty payload; a null url leaves the target out. Rows with a null page_id are responses that nothing
    refers to; so are further rows of a response's page_id with the same payload. Other columns are ignored. An empty table gives an empty index.
    """
    spark = pages.sparkSession
    store.small_batches(spark, 100)
    root = spark._jvm.org.apache.hadoop.fs.Path(out)
    root.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(root)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"sha": F.sha1("payload"), "length": F.octet_length("payload").cast("long")})
    groups = rows.select("page_id", "sha", "length").groupBy("sha", "length").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = store.materialize(groups, "payloads")
    # payloads that occur once need no partner; one that very many rows have is decided where the rows are read, before payloads move
    rows = meet(rows, groups.filter("n > 1"), ["sha", "length"], pages.count(), how="left")
    refers = F.when(F.col("page_id") > F.col("first"), F.col("first"))
    rows = rows.select("page_id", "url", "sha", "length", refers.alias("refers_to"), F.when(refers.isNull(), F.col("payload")).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, writer = f"part-{TaskContext.get().partitionId():06d}", 0, None
        for batch in batches:
            for page_id, url, sha, length, refers_to, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if writer is None:
                    name = f"{part}-{number:04d}.warc.zst"
                    fs, path = store.open_fs(f"{out}/{name}")
                    own = f"{path}.{uuid.uuid4().hex}"
                    sink = fs.open_output_stream(own, compression=None)
                    writer, number = Writer(sink), number + 1
                writer.write(record(page_id, url, payload, length, base64.b32encode(bytes.fromhex(sha)).decode(), refers_to))
                if writer.at >= ARCHIVE_BYTES:
                    yield _close(writer, sink, fs, own, path, name)
                    writer = None
            if writer is not None and (placed := writer.take_placed()):
                yield _index(name, placed)
        if writer is not None:
            yield _close(writer, sink, fs, own, path, name)

    index = rows.mapInArrow(run, INDEX)
    index.write.mode("overwrite").parquet(f"{out}/_index")
    return spark.read.schema(index.schema).parquet(f"{out}/_index")


def _index(name: str, placed: list[tuple[int, int]]) -> pa.RecordBatch:
    offsets, lengths = (pa.array(c, pa.int64()) for c in (zip(*placed) if placed else ((), ())))
    return pa.RecordBatch.from_arrays([pa.array([name] * len(placed), pa.string()), offsets, lengths], ["file", "offset", "length"])


def _close(writer: Writer, sink, fs, own: str, path: str, name: str) -> pa.RecordBatch:
    writer.close()
    sink.close()
    fs.move(own, path)
    return _index(name, writer.take_placed())


def read(spark: SparkSession, out: str) -> DataFrame:
    """(page_id, url, record_type, payload_digest, payload_bytes, refers_to) of each record, digests recomputed from stored payloads. Each
    archive is one task's, streamed."""
    files = spark.read.parquet(f"{out}/_index").select("file").distinct()
    n = max(1, files.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        number = lambda urn: int(urn[10:-1]) if urn.startswith("<urn:page:") else None
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, path = store.open_fs(f"{out}/{name}")
                rows: list[tuple] = []
                with fs.open_input_stream(path, compression=None) as source:
                    for fields, block in read_archive(source):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        kind, claimed = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                        length = int(head.rpartition(b"Content-Length: ")[2])
                        if kind == "response" and (len(payload) != length or digest(payload) != claimed):
                            raise ValueError(f"{name}: {fields['warc-record-id']} differs from its digest")
                        refers = fields.get("warc-refers-to")
                        rows.append((number(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, claimed, length, number(refers) if refers else None))
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return files.repartition(n).mapInArrow(run, "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = store.scratch(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), out)
    return read(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base 32 of the SHA-1: each of its 32 characters stands for five bits, which lie within two hexadecimal digits.
_BASE32 = "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(sha1(p), (5 * i) // 4 + 1, 2))::INT >> (3 - (5 * i) % 4)::INT) & 31) + 1)::INT, 1)), '')"
OP1_SQL = f"""
WITH base AS (SELECT page_id, coalesce(html, '') AS p, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, strlen(p)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM base
"""
