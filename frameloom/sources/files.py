"""Reading and writing: audio, JSON lines, logs, transcript trees, archives. Spark's readers list and read; decoding runs in Arrow batches."""

from __future__ import annotations

import csv
import io
import json
import os
import struct
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import archives
from ..operators.contracts import ContractError, _raise_if, unique

MANIFEST = "id string, speaker_id string, clean string, noisy string, sample_rate int, num_samples long, split string, source_partition string, noise string, snr_db double"
TRANSCRIPT = "sequence int, text string, duration_seconds double, speech_frames int, total_frames int, endpoint_reason string, asr_seconds double, queue_seconds double, end_to_text_seconds double, start_seconds double, end_seconds double"


OPENING = 32 << 10  # bytes that opening a small file is worth, where many are read
FOLDERS = 64  # of written audio
SAMPLES = 1 << 22  # most samples in a decoded batch, beyond its first file


def decode_wav(data: bytes) -> tuple[np.ndarray, int]:
    """(samples of one channel as float32, rate) of 16-bit whole or 32-bit float RIFF audio."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, kind = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
            if kind == 0xFFFE:
                kind = struct.unpack_from("<H", body, 24)[0]
            if channels != 1:
                raise ValueError("audio must have one channel")
        elif name == b"data":
            if (kind, bits) == (1, 16):
                return np.frombuffer(body, "<i2").astype(np.float32) / 32768, rate
            if (kind, bits) == (3, 32):
                x = np.frombuffer(body, "<f4")
                if not np.isfinite(x).all():
                    raise ValueError("audio must be finite")
                return x, rate
            raise ValueError("unknown sample format")
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


def encode_wav(samples, rate: int) -> bytes:
    """32-bit float RIFF audio; amplitudes are kept as they are."""
    body = np.asarray(samples, "<f4").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 3, 1, rate, 4 * rate, 4, 32) + b"data" + struct.pack("<I", len(body)) + body


def _for_small_files(spark: SparkSession) -> SparkSession:
    """A session of the same settings whose scans count a file's opening as OPENING bytes: by Spark's 4 MB, 32 files make a task, however small they are."""
    out = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if out.conf.isModifiable(k):
            out.conf.set(k, v)
    out.conf.set("spark.sql.files.openCostInBytes", OPENING)
    return out


def audio_files(spark: SparkSession, path: str) -> DataFrame:
    """(stem, path, content) of all .wav files below a folder, in either case. Two files of one stem raise. A task reads as many files as hold
    spark.sql.files.maxPartitionBytes."""
    df = _for_small_files(spark).read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[wW][aA][vV]").load(path)
    df = df.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem"), "path", "content")
    unique(df.select("stem"), ["stem"])
    return df


def read_audio(spark: SparkSession, path: str) -> DataFrame:
    """(stem, samples, sample_rate, sha256), decoded where the files are read."""

    return _decoded(audio_files(spark, path).select("stem", "content", F.sha2("content", 256).alias("sha256")))


def _decoded(files: DataFrame) -> DataFrame:
    def rows(batch: pa.RecordBatch, first: int, found: list) -> pa.RecordBatch:
        ends = np.cumsum([0, *(len(x) for x, _ in found)], dtype=np.int32)
        samples = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([x for x, _ in found]), pa.float32()))
        part = batch.slice(first, len(found))
        return pa.RecordBatch.from_arrays([part.column(0), samples, pa.array([rate for _, rate in found], pa.int32()), part.column(2)], ["stem", "samples", "sample_rate", "sha256"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, held = [], 0
            for i in range(batch.num_rows):
                found.append(decode_wav(batch.column(1)[i].as_py()))
                held += len(found[-1][0])
                if held >= SAMPLES or i == batch.num_rows - 1:
                    yield rows(batch, i + 1 - len(found), found)
                    found, held = [], 0

    return files.mapInArrow(run, "stem string, samples array<float>, sample_rate int, sha256 string")


def write_files(df: DataFrame, folder: str) -> DataFrame:
    """Writes ``df(name, content)``, a relative path and bytes, below a folder that executors share (a URI); returns (name, path). Each file is renamed
    when whole, so a repeated task does no harm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        made = set()
        for batch in batches:
            paths = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                path = f"{base}/{name}"
                part = f"{path}.{uuid.uuid4().hex}.part"
                if (above := path.rpartition("/")[0]) not in made:
                    system.create_dir(above, recursive=True)
                    made.add(above)
                with system.open_output_stream(part) as sink:
                    sink.write(content.as_py())
                system.move(part, path)
                paths.append(path)
            yield pa.RecordBatch.from_pydict({"name": batch.column(0), "path": pa.array(paths, pa.string())})

    return df.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(run, "name string, path string")


def encoded_audio(df: DataFrame) -> DataFrame:
    """``df(stem, samples, sample_rate)`` as (name, content) of .wav files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, values = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy(zero_copy_only=False)
            audio = [encode_wav(values[a:b], rate) for a, b, rate in zip(ends[:-1], ends[1:], batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_pydict({"name": pa.array([f"{s}.wav" for s in batch.column(0).to_pylist()], pa.string()), "content": pa.array(audio, pa.binary())})

    return df.select("stem", "samples", "sample_rate").mapInArrow(run, "name string, content binary")


def write_audio(df: DataFrame, folder: str) -> DataFrame:
    """Writes ``df(stem, samples, sample_rate)`` as .wav files below a folder that executors share, dealt to FOLDERS folders by their stems, as tasks
    that write into one wait for each other; returns (stem, path)."""
    inner = F.format_string("%02x/", F.pmod(F.crc32(F.col("name").cast("binary")), F.lit(FOLDERS)))
    found = write_files(encoded_audio(df).withColumn("name", F.concat(inner, "name")), folder)
    return found.select(F.regexp_replace("name", r"^[^/]*/|\.wav$", "").alias("stem"), "path")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The object, or the objects of the list, that each file holds; anything else raises when it is read."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of metrics from CSV with a header; a header of other names, or a value of another kind, raises when it is read."""
    return spark.read.schema(schema).option("header", "true").option("enforceSchema", "false").option("mode", "FAILFAST").csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object on each line that isn't blank; anything else raises when it is read."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("o")).select("o.*")


def read_condition_log(spark: SparkSession, path: str) -> DataFrame:
    """(id, noise, snr_db) of lines of three fields. Other lines, repeated ids and an empty log raise."""
    return _condition_log(spark.read.text(path))


def _condition_log(lines: DataFrame) -> DataFrame:
    parts = F.split(F.trim("value"), r"\s+")
    df = lines.filter(F.trim("value") != "").select(parts.alias("p"))
    _raise_if(df.filter(F.size("p") != 3), "a log line must have three fields")
    out = df.select(F.col("p")[0].alias("id"), F.col("p")[1].alias("noise"), F.col("p")[2].cast("double").alias("snr_db"))
    if out.isEmpty():
        raise ContractError("the log is empty")
    return unique(out, ["id"])


def read_condition_log_zip(spark: SparkSession, members: list, glob: str) -> DataFrame:
    """The same of the members of archives whose names fit ``glob``; each is unpacked by a task, and a mark at its start goes. No such member is an empty log."""
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^\\uFEFF", "")
    return _condition_log(archives.read_members(spark, members, glob).select(F.explode(F.split(text, r"\r\n|\r|\n")).alias("value")))


def pair_files(clean: DataFrame, noisy: DataFrame) -> DataFrame:
    """(id, speaker_id, clean, noisy) of two tables (stem, path); files of one side only raise. The speaker is the id up to its first _."""
    both = clean.select("stem", F.col("path").alias("clean")).join(noisy.select("stem", F.col("path").alias("noisy")), "stem", "full_outer")
    _raise_if(both.filter("clean is null or noisy is null"), "every clean file needs a noisy one")
    return both.select(F.col("stem").alias("id"), F.substring_index("stem", "_", 1).alias("speaker_id"), "clean", "noisy")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(id, speaker_id, reference_raw) of all .txt files below a folder, without those that start with ._; byte order marks and outer white
    space go. The speaker is the file's folder."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.txt$", 1)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    text = F.regexp_replace(F.regexp_replace("value", "^\\uFEFF", ""), r"^\s+|\s+$", "")
    return df.select(name.alias("id"), folder.alias("speaker_id"), text.alias("reference_raw")).filter(~F.col("id").startswith("._"))


def match_transcripts(manifest: DataFrame, transcripts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matched rows, problems): every problem of every row is found before anything raises."""
    found = manifest.join(transcripts.groupBy("id").agg(F.count("*").alias("n"), F.first("reference_raw").alias("reference_raw"), F.first("speaker_id").alias("_folder")), "id", "left")
    checks = F.array_compact(F.array(F.when(F.col("n").isNull(), "missing"), F.when(F.col("n") > 1, "several"), F.when(F.col("_folder") != F.col("speaker_id"), "speaker"), F.when(F.col("reference_raw") == "", "empty")))
    found = found.withColumn("problems", checks)
    return found.filter(F.size("problems") == 0).drop("problems", "n", "_folder"), found.filter(F.size("problems") > 0).select("id", F.explode("problems").alias("problem"))


def _replace(path: str, data: bytes) -> None:
    """Writes beside and renames; what was there stays until then."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, part = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, target)
    except BaseException:
        Path(part).unlink(missing_ok=True)
        raise


def write_json(path: str, value: dict) -> None:
    _replace(path, json.dumps(value, indent=2, sort_keys=True, allow_nan=False).encode() + b"\n")


def write_csv(path: str, rows: list[dict]) -> None:
    """A small collected result."""
    out = io.StringIO()
    writer = csv.DictWriter(out, list(rows[0]) if rows else [], lineterminator="\n")
    writer.writeheader()
    writer.writerows(rows)
    _replace(path, out.getvalue().encode())


def write_jsonl(df: DataFrame, path: str) -> None:
    """A folder of JSON lines: written beside, then renamed, so that a failure leaves the old one."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    fs.delete(part, True)
    df.write.json(f"{path}.part")
    fs.delete(target, True)
    if not fs.rename(part, target):
        raise OSError(f"{path} can't be replaced")


def read_audio_archive(spark: SparkSession, members: list, most_files: int = 100_000, most_bytes: int = 1 << 40) -> DataFrame:
    """(stem, samples, sample_rate, sha256) of the .wav members of archives (see ``archives.read_members``), unpacked and decoded in tasks. Other members raise."""
    found = archives.read_members(spark, members, only="*.wav", most_files=most_files, most_bytes=most_bytes)
    stem = F.regexp_extract("name", r"([^/]+)\.[^./]+$", 1).alias("stem")
    return _decoded(found.select(stem, "content", F.sha2("content", 256).alias("sha256")))


def extract_audio(spark: SparkSession, members: list, folder: str, most_files: int = 100_000, most_bytes: int = 1 << 40) -> DataFrame:
    """(name, path) of the .wav members of archives, each written by the task that unpacks it below a new folder (a URI). Tasks write beside it, and it gets its name when all are done, so that
    it is there whole or not at all. A folder that exists raises, as does what ``archives.read_members`` refuses."""
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(folder)
    beside = f"{folder}.{uuid.uuid4().hex}"
    try:
        names = write_files(archives.read_members(spark, members, only="*.wav", most_files=most_files, most_bytes=most_bytes), beside).select("name")
        names = names.persist(StorageLevel.DISK_ONLY)
        names.count()
        if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(beside)):
            fs.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(beside))  # no members
        if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(beside), target):
            raise OSError(f"{folder} can't be made")
    finally:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(beside), True)
    return names.select("name", F.concat(F.lit(f"{folder}/"), "name").alias("path"))
