"""Token ids in Parquet list columns, in ascending doc_id order.

One file for each range of doc_id; in a file one row for each document: doc_id and n_tokens, delta encoded, and ids (a list
column, dictionary or delta encoded). Row groups end at ``GROUP_TOKENS`` ids or ``GROUP_ROWS`` rows, pages are small, and page
indexes are written; so a reader takes the metadata columns without the ids, or the ids of a few documents, without the rest.

A task writes under a name of its own and renames the file when it is whole; a repeated task replaces it with the same
content. The manifest (a row for each file) is kept beside the files.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import store
from .pieces import library_encoder

END = 2
GROUP_TOKENS, GROUP_ROWS = 1 << 20, 1 << 16
PAGE_BYTES = 1 << 16
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])


def encoded(batches: Iterator[pa.RecordBatch], path: str, end: int = END) -> Iterator[pa.Table]:
    """doc_id, n_tokens and ids, the end id included, of batches of (doc_id, text)."""
    encoder = library_encoder(path)
    for batch in batches:
        for a, b, ids, counts in encoder.encode(batch.column(1)):
            counts = counts + 1
            stop = np.cumsum(counts)
            out = np.full(int(stop[-1]), end, np.int32)
            keep = np.ones(len(out), bool)
            keep[stop - 1] = False
            out[keep] = ids
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stop]).astype(np.int32)), pa.array(out))
            yield pa.table([batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), lists], schema=SCHEMA)


def write_file(uri: str, tables: Iterator[pa.Table], encoding: str) -> tuple[int, int]:
    """(documents, ids) written; ``encoding`` is dictionary or delta."""
    fs, path = store.open_fs(uri)
    part = f"{path}.{uuid.uuid4().hex}"
    delta = {"doc_id": "DELTA_BINARY_PACKED", "n_tokens": "DELTA_BINARY_PACKED"}
    if encoding == "delta":
        delta["ids.list.element"] = "DELTA_BINARY_PACKED"
    documents = total = 0
    with fs.open_output_stream(part) as sink:
        options = {"use_dictionary": ["ids.list.element"] if encoding == "dictionary" else False, "column_encoding": delta}
        with pq.ParquetWriter(sink, SCHEMA, compression="zstd", data_page_size=PAGE_BYTES, dictionary_pagesize_limit=1 << 20, write_page_index=True, write_statistics=True, **options) as writer:
            held: list[pa.Table] = []
            rows = ids = 0
            for t in tables:
                held.append(t)
                rows, ids = rows + t.num_rows, ids + len(t.column("ids").chunk(0).values)
                if ids >= GROUP_TOKENS or rows >= GROUP_ROWS:
                    writer.write_table(pa.concat_tables(held).combine_chunks(), row_group_size=rows)
                    held, documents, total, rows, ids = [], documents + rows, total + ids, 0, 0
            if held:
                writer.write_table(pa.concat_tables(held).combine_chunks(), row_group_size=rows)
            documents, total = documents + rows, total + ids
    fs.move(part, path)
    return documents, total


def write(documents: DataFrame, out: str, path: str, encoding: str = "dictionary", end: int = END) -> DataFrame:
    """Writes ``documents(doc_id, text)`` below the URI ``out``; returns the manifest (file, documents, ids), in order of ``file``.

    Null texts are empty, rows of one doc_id stay together, in order of their texts; a null doc_id comes first. Other columns are ignored.
    """
    spark = documents.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(out)
    root.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():06d}.parquet"
        first = next(batches, None)
        if first is None:
            return

        def all_batches() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        n, ids = write_file(f"{out}/{name}", encoded(all_batches(), path, end), encoding)
        yield pa.RecordBatch.from_pydict({"file": [name], "documents": [n], "ids": [ids]})

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = rows.mapInArrow(run, "file string, documents long, ids long")
    store.small_batches(spark)
    manifest.write.mode("overwrite").parquet(f"{out}/_manifest")
    return read_manifest(spark, out)


def read_manifest(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("file string, documents long, ids long").parquet(f"{out}/_manifest").orderBy("file")


def read(spark: SparkSession, out: str, columns: list[str] | None = None) -> DataFrame:
    """The rows, by Spark's reader: columns not asked for aren't read, and filters on doc_id skip row groups and pages."""
    names = [r["file"] for r in read_manifest(spark, out).select("file").collect()]
    kind = "doc_id long, n_tokens long, ids array<int>"
    df = spark.read.schema(kind).parquet(*(f"{out}/{n}" for n in names)) if names else spark.createDataFrame([], kind)
    return df.select(*columns) if columns else df


def checksums(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: each is read by one task, a row group at a time. Starts follow from the
    manifest's totals, of which there is one for each file."""
    start, starts = 0, []
    for r in read_manifest(spark, out).collect():
        starts.append((r["file"], start))
        start += r["ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, path = store.open_fs(f"{out}/{name}")
                with fs.open_input_file(path) as source:
                    table = pq.ParquetFile(source)
                    for g in range(table.num_row_groups):
                        t = table.read_row_group(g, columns=["doc_id", "ids"]).combine_chunks().to_batches()[0]
                        lists = t.column("ids")
                        stop = lists.offsets.to_numpy().astype(np.int64)
                        raw = memoryview(np.ascontiguousarray(lists.values.to_numpy()).astype("<i4", copy=False)).cast("B")
                        crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(stop[:-1].tolist(), stop[1:].tolist())]
                        yield pa.RecordBatch.from_pydict({"doc_id": t.column("doc_id"), "start": pa.array(at + stop[:-1] - stop[0]), "n_tokens": pa.array(np.diff(stop)), "ids_crc32": pa.array(crc, pa.int64())})
                        at += int(stop[-1] - stop[0])

    if not starts:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.createDataFrame(starts, "file string, start long").repartition(len(starts))
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = store.scratch(spark, "tokens")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), out, byte_bpe())
    return checksums(spark, out)
