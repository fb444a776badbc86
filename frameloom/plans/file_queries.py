"""Queries that write to the shared folder and read back, and queries that run as streams; each with the SQL that its rows must agree with."""

from __future__ import annotations

from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import kernels, recurrent
from ..functions.settings import Framing
from ..operators import signals, statistics
from ..shared import scratch
from ..sources import archives, files
from ..streaming import chunks, live
from .derived import PAIRS, SCORES, SIGNAL, pairs, scores, signal, table, vectors
from .kernel_queries import _P, ENDPOINTS
from .queries import _LIST, _SUMMARY, ORACLE_SQL, QUERIES, _weighted, query

__all__ = ["ORACLE_SQL", "QUERIES"]

_VECTORS = "vectors AS (SELECT vec_id AS stream, embedding::DOUBLE[] AS samples FROM embeddings)"


def _audio(df: DataFrame) -> DataFrame:
    """Clips are dealt to tasks, as the rows of many may lie in one row group."""
    return df.repartition("stream").select(F.concat(F.lit("s"), F.col("stream") % 5, F.lit("_"), "stream").alias("stem"), "samples", F.lit(16000).alias("sample_rate"))


@query(f"WITH {_VECTORS} SELECT 's' || (stream % 5) || '_' || stream AS stem, 16000::INT AS sample_rate, len(samples)::INT AS n, round({_LIST('samples')}, 6) AS weighted FROM vectors")
def audio_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "audio")
    files.write_audio(_audio(vectors(spark, sf_dir)), folder).count()
    return files.read_audio(spark, folder).select("stem", "sample_rate", F.size("samples").alias("n"), _weighted("samples").alias("weighted"))


@query("SELECT 's' || (vec_id % 5) || '_' || vec_id AS id, 's' || (vec_id % 5) AS speaker_id, 's' || (vec_id % 5) || '_' || vec_id || '.wav' AS clean, 's' || (vec_id % 5) || '_' || vec_id || '.wav' AS noisy FROM embeddings")
def paired_files(spark, sf_dir):
    sides = []
    for side in ("clean", "noisy"):
        folder = scratch(spark, side)
        files.write_audio(_audio(vectors(spark, sf_dir)), folder).count()
        sides.append(files.audio_files(spark, folder))
    found = files.pair_files(*sides)
    return found.select("id", "speaker_id", *(F.substring_index(c, "/", -1).alias(c) for c in ("clean", "noisy")))


@query(f"WITH {PAIRS}, sides AS (SELECT 'half' AS method, stream, list_transform(reference, lambda x, i: (0.5::DOUBLE * estimate[i] + 0.5::DOUBLE * x)::FLOAT::DOUBLE) AS y FROM pairs UNION ALL SELECT 'whole', stream, list_transform(estimate, lambda x: x::FLOAT::DOUBLE) FROM pairs) SELECT method, 's' || (stream % 5) || '_' || stream AS stem, len(y)::INT AS n, round({_LIST('y')}, 5) AS weighted FROM sides")
def exported_outputs(spark, sf_dir):
    """Each method's output as audio below a folder of its own, and a manifest of what was written, which is read back with the audio."""
    folder = scratch(spark, "export")
    for method, share in (("half", 0.5), ("whole", 1.0)):
        mixed = pairs(spark, sf_dir).select("stream", signals.residual_mix(share, "estimate", "reference").alias("samples"))
        written = files.write_audio(_audio(mixed), f"{folder}/{method}").select(F.lit(method).alias("method"), "stem")
        files.write_jsonl(written, f"{folder}/manifest-{method}")
    out = None
    for method in ("half", "whole"):
        listed = files.read_jsonl(spark, f"{folder}/manifest-{method}", "method string, stem string")
        found = listed.join(files.read_audio(spark, f"{folder}/{method}"), "stem", "left")
        out = found if out is None else out.unionByName(found)
    weighted = F.aggregate(F.transform("samples", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return out.select("method", "stem", F.size("samples").alias("n"), F.round(weighted, 5).alias("weighted"))


@query("SELECT 'd' || doc_id AS id, coalesce(lang, 'none') AS noise, (doc_id % 4) * 5.0::DOUBLE AS snr_db FROM documents")
def condition_log(spark, sf_dir):
    folder = scratch(spark, "log")
    line = F.concat(F.lit("  d"), "doc_id", F.lit("\t"), F.coalesce("lang", F.lit("none")), F.lit("   "), ((F.col("doc_id") % 4) * 5.0).cast("string"))
    table(spark, sf_dir, "documents").select(line.alias("value")).write.text(folder)
    return files.read_condition_log(spark, folder)


@query("SELECT 'd' || doc_id AS id, coalesce(lang, 'none') AS noise, (doc_id % 4) * 5.0::DOUBLE AS snr_db FROM documents")
def condition_log_archive(spark, sf_dir):
    """The log as members of some hundred lines in archives, written and read by tasks."""
    line = F.concat(F.lit("d"), "doc_id", F.lit(" "), F.coalesce("lang", F.lit("none")), F.lit(" "), ((F.col("doc_id") % 4) * 5.0).cast("string"))
    lines = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 256).alias("k"), line.alias("line"))
    members = lines.groupBy("k").agg(F.concat(F.lit("\ufeff"), F.array_join(F.collect_list("line"), "\r\n")).alias("content"))
    written = archives.write_archives(members.select(F.format_string("logs/%d.txt", "k").alias("name"), "content"), scratch(spark, "log"))
    return files.read_condition_log_zip(spark, [r.path for r in written.collect()], "logs/*.txt")


_TREE = """m AS (SELECT item_id, 'i' || item_id AS id, 's' || (item_id % 5 + (item_id % 17 = 0)::INT) AS speaker_id, CASE WHEN item_id % 13 = 0 THEN '' ELSE trim(text) END AS t FROM benchmark),
c AS (SELECT id, t, list_filter([CASE WHEN item_id % 11 = 0 THEN 'missing' END, CASE WHEN item_id % 11 <> 0 AND item_id % 17 = 0 THEN 'speaker' END, CASE WHEN item_id % 11 <> 0 AND t = '' THEN 'empty' END], lambda x: x IS NOT NULL) AS p FROM m)"""


@query(f"WITH {_TREE} SELECT id, NULL AS problem, sha256(t) AS digest FROM c WHERE len(p) = 0 UNION ALL SELECT id, unnest(p), NULL FROM c")
def transcript_tree(spark, sf_dir):
    """Texts as files below their speakers' folders, with marks and white space around them, matched with a manifest: rows that match, and what is wrong with others."""
    folder = scratch(spark, "texts")
    df = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("k"), F.btrim("text").alias("t"))
    inner = F.when(F.col("k") % 13 == 0, "").otherwise(F.col("t"))
    tree = df.filter("k % 11 <> 0").select(F.format_string("s%d/i%d.txt", F.col("k") % 5, "k").alias("name"), F.concat(F.lit("\ufeff"), F.lit(" \n"), inner, F.lit("\n\n")).alias("content"))
    hidden = df.limit(1).select(F.lit("s0/._i1.txt").alias("name"), F.lit("hidden").alias("content"))
    files.write_files(tree.unionByName(hidden), folder).count()
    manifest = df.select(F.concat(F.lit("i"), "k").alias("id"), F.concat(F.lit("s"), F.col("k") % 5 + (F.col("k") % 17 == 0).cast("int")).alias("speaker_id"))
    matched, problems = files.match_transcripts(manifest, files.read_transcripts(spark, folder))
    good = matched.select("id", F.lit(None).cast("string").alias("problem"), F.sha2("reference_raw", 256).alias("digest"))
    return good.unionByName(problems.withColumn("digest", F.lit(None).cast("string")))


@query("SELECT conv_id, turn, role, sha256(coalesce(text, '')) AS digest FROM conversations")
def jsonl_roundtrip(spark, sf_dir):
    folder = scratch(spark, "lines")
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    files.write_jsonl(df, folder)
    back = files.read_jsonl(spark, folder, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema))
    return back.select("conv_id", "turn", "role", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


@query(f"WITH {SCORES} SELECT condition, {_SUMMARY} FROM scores GROUP BY condition")
def metrics_files(spark, sf_dir):
    """Metrics as CSV, read with their schema and summarized; the summary as JSON, replaced whole and read again."""
    folder = scratch(spark, "metrics")
    scores(spark, sf_dir).select("condition", "id", F.col("value").cast("double").alias("value")).write.option("header", "true").csv(folder)
    read = files.read_metrics(spark, folder, "condition string, id long, value double")
    found = statistics.summary(read, "value", [["condition"]]).drop("level")
    report = _local(scratch(spark, "report")) / "summary.json"
    files.write_json(str(report), {"rows": [r.asDict() for r in found.collect()]})
    back = files.read_json(spark, report.as_uri(), f"rows array<{found.schema.simpleString()}>")
    return back.select(F.explode("rows").alias("r")).select("r.*")


def _local(uri: str) -> Path:
    at = urlparse(uri)
    if at.scheme not in ("", "file"):
        raise ValueError("archives and reports of the driver need a shared folder in the file system")
    return Path(at.path)


def _in_ranges(spark, written: DataFrame, n: int, beyond: bytes) -> list:
    """Each archive of ``written(path, size)`` copied by tasks to ``n`` files, each with ``beyond`` after its range; the ranges of each archive."""

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, at = fs.FileSystem.from_uri(path)
                names, sizes = [], []
                with system.open_input_file(at) as source:
                    for k in range(n):
                        take = size * (k + 1) // n - size * k // n
                        with system.open_output_stream(f"{at}.{k}") as sink:
                            sink.write(source.read(take) + beyond)
                        names.append(f"{path}.{k}")
                        sizes.append(take)
                yield pa.RecordBatch.from_arrays([pa.array([names]), pa.array([sizes], pa.list_(pa.int64())), pa.array([size], pa.int64())], ["names", "sizes", "size"])

    cut = written.select("path", "size").mapInArrow(run, "names array<string>, sizes array<long>, size long")
    return [archives.checked_ranges(list(zip(r.names, r.sizes)), r.size) for r in cut.collect()]


@query(f"WITH {_VECTORS} SELECT 's' || (stream % 5) || '_' || stream AS stem, round({_LIST('samples')}, 6) AS weighted FROM vectors")
def archived_audio(spark, sf_dir):
    """Audio packed into archives by tasks, each archive cut into ranges of longer files, unpacked from these ranges by tasks, and read."""
    packed = files.encoded_audio(_audio(vectors(spark, sf_dir))).withColumn("name", F.concat(F.lit("clips/"), "name"))
    written = archives.write_archives(packed, scratch(spark, "archive"))
    # written once: the paths are those of the archives that the first pass makes
    made = written.collect()
    written = spark.createDataFrame(made, written.schema)
    folder = scratch(spark, "clips")
    files.extract_audio(spark, _in_ranges(spark, written, 3, b"beyond the range"), folder, most_files=sum(r.members for r in made))
    return files.read_audio(spark, folder).select("stem", _weighted("samples").alias("weighted"))


# Streams --------------------------------------------------------------------------------------------------------------


FILES = 8  # of one part


def _source(spark: SparkSession, df: DataFrame, parts: int) -> DataFrame:
    """``df(stream, seq, ...)`` as a stream, every how manyth chunk at a time, so that chunks arrive out of order."""
    source, whole = scratch(spark, "source"), scratch(spark, "chunks")
    df.write.parquet(whole)
    df = spark.read.schema(df.schema).parquet(whole)
    for k in range(parts):
        df.filter(F.pmod(F.col("seq") * 7 + F.col("stream"), F.lit(parts)) == k).repartition(FILES).write.mode("append").parquet(source)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", FILES).parquet(source)


def _as_stream(spark: SparkSession, df: DataFrame, operator, parts: int = 3, other: DataFrame | None = None) -> DataFrame:
    """What ``operator`` gives for the chunks ``df`` (and those of ``other``) as a stream of some ``parts`` micro-batches."""
    given = [x for x in (df, other) if x is not None]
    out, state = scratch(spark, "sink"), scratch(spark, "state")
    running = operator(*(_source(spark, x, parts) for x in given)).writeStream.format("parquet").outputMode("append").option("checkpointLocation", state).option("path", out).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(operator(*given).schema).parquet(out)


def _joined(df: DataFrame) -> DataFrame:
    """(stream, n, value): the chunks' samples in order of seq."""
    from pyspark.sql import Window

    at = df.select("stream", "seq", F.posexplode("samples").alias("k", "value"))
    w = Window.partitionBy("stream").orderBy("seq", "k")
    return at.select("stream", (F.row_number().over(w) - 1).cast("long").alias("n"), "value")


SLOW = Framing(16, 4)


@query(f"WITH {SIGNAL} SELECT stream, n, round(value, 6) AS value FROM signal")
def stream_overlap_add(spark, sf_dir):
    df = chunks.as_chunks(signal(spark, sf_dir), 7)
    out = _as_stream(spark, df, lambda c: chunks.overlap_add(c, SLOW))
    return _joined(out).select("stream", "n", F.round("value", 6).alias("value"))


def _double(block):
    return 2 * block


@query(f"WITH {SIGNAL} SELECT stream, n, round(2 * value, 6) AS value FROM signal")
def stream_blocks(spark, sf_dir):
    df = chunks.as_chunks(signal(spark, sf_dir), 7)
    out = _as_stream(spark, df, lambda c: chunks.block_model(c, _double, 12))
    return _joined(out).select("stream", "n", F.round("value", 6).alias("value"))


_TAPS = "taps AS (SELECT unnest(range(0, {n})) AS k, unnest([{h}]) AS h)".format(n=len(kernels.TAPS), h=", ".join(f"{x!r}::DOUBLE" for x in kernels.TAPS.tolist()))
_UP = f"{SIGNAL}, {_TAPS}, sizes AS (SELECT stream, count(*) AS size FROM signal GROUP BY stream), up AS (SELECT s.stream, 3 * s.n + k AS m, sum(3 * h * value) AS y FROM signal s, taps JOIN sizes z ON z.stream = s.stream WHERE 3 * s.n + k < 3 * z.size GROUP BY ALL)"


@query(f"WITH {_UP} SELECT stream, m AS n, round(y, 6) AS value FROM up")
def stream_upsample(spark, sf_dir):
    out = _as_stream(spark, chunks.as_chunks(signal(spark, sf_dir), 16), chunks.upsample3)
    return _joined(out).select("stream", "n", F.round("value", 6).alias("value"))


@query(f"WITH {SIGNAL}, {_TAPS}, sizes AS (SELECT stream, count(*) AS size FROM signal GROUP BY stream), full_ AS (SELECT s.stream, s.n + k AS m, sum(h * value) AS y FROM signal s, taps JOIN sizes z ON z.stream = s.stream WHERE s.n + k < z.size GROUP BY ALL) SELECT stream, m // 3 AS n, round(y, 6) AS value FROM full_ WHERE m % 3 = 0")
def stream_downsample(spark, sf_dir):
    out = _as_stream(spark, chunks.as_chunks(signal(spark, sf_dir), 16), chunks.downsample3)
    return _joined(out).select("stream", "n", F.round("value", 6).alias("value"))


def _copy(samples):
    return samples


@query(f"WITH {_UP}, long AS (SELECT stream, size, unnest(range(0, size + 42)) AS n FROM sizes), back AS (SELECT l.stream, l.n, sum(h * y) AS value FROM long l, taps JOIN (SELECT s.stream, 3 * s.n + k AS m, sum(3 * h * value) AS y FROM signal s, taps GROUP BY ALL) u ON u.stream = l.stream AND u.m = 3 * l.n - taps.k GROUP BY ALL) SELECT stream, n, round(value, 6) AS value FROM back")
def stream_through_48k(spark, sf_dir):
    """Three times the rate and back, with the tail of the filters' delay."""
    out = _as_stream(spark, chunks.as_chunks(signal(spark, sf_dir), 16), lambda c: chunks.through_48k(c, _copy))
    return _joined(out).select("stream", "n", F.round("value", 6).alias("value"))


@query(ENDPOINTS)
def stream_endpoints(spark, sf_dir):
    """Segments of live activity, from chunks that come out of order."""
    df = signal(spark, sf_dir).withColumn("value", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / 490)))
    out = _as_stream(spark, chunks.as_chunks(df, 7), lambda c: chunks.endpoints(c, _P))
    return out.select("stream", F.col("start_frame").alias("start"), F.col("end_frame").alias("stop"), F.col("speech_frames").alias("speech"), F.col("total_frames").alias("total"), "reason")


_FOURS = f"{SIGNAL}, sizes AS (SELECT stream, count(*) // 4 AS frames FROM signal GROUP BY stream)"


@query(f"WITH {_FOURS} SELECT s.stream, n // 4 AS frame, round(max(value), 6) AS activity, round(sum(value * (n % 4 + 1)), 6) AS weighted FROM signal s JOIN sizes z ON z.stream = s.stream AND s.n < 4 * frames GROUP BY s.stream, n // 4")
def stream_aligned_activity(spark, sf_dir):
    """Frames of four samples and an activity for each, chunks of 10 samples and of 3 activities, each side out of order."""
    df = signal(spark, sf_dir)
    whole = df.join(df.groupBy("stream").agg((F.floor(F.count("*") / 4) * 4).alias("size")), "stream").filter("n < size").select("stream", "n", "value")
    activity = whole.groupBy("stream", F.floor(F.col("n") / 4).alias("n")).agg(F.max("value").alias("value"))
    out = _as_stream(spark, chunks.as_chunks(whole, 10), lambda s, a: live.aligned(s, a, 4), other=chunks.as_chunks(activity, 3))
    return out.select("stream", "frame", F.round("activity", 6).alias("activity"), _weighted("samples").alias("weighted"))


_QUEUE = "SELECT stream, n, work, {full} AS dropped, CASE WHEN {full} THEN free ELSE greatest(n, free) + work END AS free, CASE WHEN {full} THEN waiting ELSE list_append(waiting, greatest(n, free)) END AS starts, greatest(n, free) - n AS waits FROM (SELECT stream, n, work, free, list_filter(starts, lambda x: x > n) AS waiting FROM ({source}))"
_FULL = "len(waiting) >= 4"


@query(f"""WITH RECURSIVE {SIGNAL}, jobs AS MATERIALIZED (SELECT stream, n::DOUBLE AS n, value / 40 AS work FROM signal), q AS (
  {_QUEUE.format(full=_FULL, source="SELECT *, 0::DOUBLE AS free, CAST([] AS DOUBLE[]) AS starts FROM jobs WHERE n = 0")}
  UNION ALL {_QUEUE.format(full=_FULL, source="SELECT j.stream, j.n, j.work, q.free, q.starts FROM q JOIN jobs j ON j.stream = q.stream AND j.n = q.n + 1")})
SELECT stream, n::BIGINT AS seq, dropped, CASE WHEN NOT dropped THEN round(waits, 6) END AS queue_seconds, round(work, 6) AS work_seconds, CASE WHEN NOT dropped THEN round(waits + work, 6) END AS end_to_text_seconds FROM q""")
def stream_bounded_queue(spark, sf_dir):
    """A job each second, whose work its event's value sets, before a queue for four; what finds it full is dropped."""
    jobs = signal(spark, sf_dir).select("stream", F.col("n").alias("seq"), F.array(F.col("n").cast("double"), F.col("value") / 40).alias("values"), F.lit(False).alias("last"), F.lit(None).cast("timestamp").alias("ts"))
    out = _as_stream(spark, jobs, live.queued)
    return out.select("stream", "seq", "dropped", *(F.round(c, 6).alias(c) for c in ("queue_seconds", "work_seconds", "end_to_text_seconds")))


def _stand_in():
    def model(inputs):
        if any("?" in x for x in inputs):
            raise ValueError("no question")
        return [x.replace(" ", "_") for x in inputs]

    return model


@query("SELECT conv_id AS stream, turn::BIGINT AS seq, CASE WHEN NOT contains(text, '?') THEN sha256(replace(text, ' ', '_')) END AS digest, CASE WHEN contains(text, '?') THEN 'ValueError: no question' END AS error FROM conversations WHERE text IS NOT NULL AND turn IS NOT NULL AND conv_id IS NOT NULL")
def worker_ledger(spark, sf_dir):
    """Turns as jobs of a worker behind a stream, through a stand-in model; every batch is given to the sink twice."""
    df = table(spark, sf_dir, "conversations").filter("text is not null and turn is not null and conv_id is not null")
    jobs = df.select(F.col("conv_id").cast("long").alias("stream"), F.col("turn").cast("long").alias("seq"), F.col("text").alias("input"), F.unix_timestamp().cast("double").alias("ended"))
    sink = live.Ledger(scratch(spark, "worker"), lambda batch: live.worked(batch, _stand_in))

    def twice(batch, number):
        sink(batch, number)
        sink(batch, number)

    _source(spark, jobs, 3).writeStream.foreachBatch(twice).option("checkpointLocation", scratch(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    return sink.rows(spark).select("stream", "seq", F.sha2("text", 256).alias("digest"), "error")


_MODEL = recurrent.FrameModel(frame=8, bands=4, hidden=6, shortest=2, longest=16)


@query()
def stream_frame_model(spark, sf_dir):
    """Events through a recurrent frame model, whose weights come from a table, chunk by chunk and out of order: samples and their activities' sum."""
    sizes = [(name, int(np.prod(_MODEL.shape(name)))) for name in recurrent.SHAPES]
    each = F.sin(F.crc32(F.concat_ws(":", "name", "place").cast("binary")).cast("double"))
    weights = spark.createDataFrame(sizes, "name string, n int").select("name", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("place")).select("name", "place", each.alias("value"))
    held = chunks.model_weights(weights)
    df = signal(spark, sf_dir).withColumn("value", F.col("value") / 490)
    out = _as_stream(spark, chunks.as_chunks(df, 10), lambda c: chunks.frame_model(c, _MODEL, held))
    totals = lambda c, at: F.sum(F.expr(f"aggregate(transform({c}, (x, i) -> x * ({at})), 0D, (a, x) -> a + x)"))
    return out.groupBy("stream").agg(F.sum(F.size("samples")).alias("n"), F.round(totals("samples", "1"), 6).alias("total"), F.sum(F.size("activity")).alias("frames"), F.round(totals("activity", "1"), 6).alias("activity"))
