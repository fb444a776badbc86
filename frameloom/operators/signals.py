"""Streams as ordered samples: frames, windows, recurrences, segments and activity in DataFrame operations, spectral kernels by Arrow batches.

A long stream table has (stream, n, value), n from 0 without gaps; an array table has (stream, samples). Trailing windows and
first-order recurrences run on blocks of a stream (``scans``), framing on frames. Runs of labels keep a stream's order by windows partitioned by
stream: a very long stream is one task there, as each other ``recurrence`` is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import kernels
from ..functions.settings import Framing
from . import scans

TINY = 2.2250738585072014e-308


def frame_members(df: DataFrame, at: Framing, lead: int = 0) -> DataFrame:
    """(stream, frame, offset, value): each sample in every frame that holds it, a bounded number; ``lead`` zeros stand before the stream."""
    first = F.greatest(F.floor((F.col("n") + lead - at.length) / at.hop) + 1, F.lit(0))
    last = F.floor((F.col("n") + lead) / at.hop)
    ends = df.groupBy("stream").agg((F.max("n") + 1).alias("size"))
    count = F.greatest(F.ceil((F.col("size") + lead - at.length) / at.hop), F.lit(0)) + 1
    rows = df.join(ends, "stream").withColumn("frame", F.explode(F.sequence(first, last))).filter(F.col("frame") < count)
    return rows.select("stream", "frame", (F.col("n") + lead - F.col("frame") * at.hop).alias("offset"), "value")


def frames_of_milliseconds(milliseconds: Column, frame: float = 10.0) -> Column:
    """Frames that hold so many milliseconds, the last begun one counted; others than positive numbers raise."""
    whole = F.ceil(milliseconds / frame).cast("long")
    return F.when(milliseconds > 0, whole).otherwise(F.raise_error(F.lit("milliseconds must be positive")).cast("long"))


def frame_energy(df: DataFrame, at: Framing, least_db: float = -120.0, lead: int = 0) -> DataFrame:
    """(stream, frame, samples, energy_db): zeros fill the frames up."""
    out = frame_members(df, at, lead).groupBy("stream", "frame").agg(F.count("*").alias("samples"), F.sum(F.col("value") * F.col("value")).alias("_s"))
    return out.withColumn("energy_db", F.round(F.greatest(10 * F.log10(F.col("_s") / at.length + TINY), F.lit(least_db)), 6)).drop("_s")


def tumbling(df: DataFrame, size: int) -> DataFrame:
    """(stream, block, samples, rms); the last block may be short."""
    return df.groupBy("stream", F.floor(F.col("n") / size).alias("block")).agg(F.count("*").alias("samples"), F.round(F.sqrt(F.mean(F.col("value") * F.col("value"))), 6).alias("rms"))


def repeated_windows(df: DataFrame, length: int, hop: int) -> DataFrame:
    """``df(stream, samples)`` as (stream, window, values): the stream doubled until it fills a window, whole windows only."""
    n = F.size("samples")
    doublings = F.greatest(F.ceil(F.log2(F.lit(float(length)) / n)), F.lit(0))
    df = df.withColumn("_n", n).withColumn("_total", (F.col("_n") * F.pow(F.lit(2.0), doublings)).cast("int"))
    df = df.withColumn("window", F.explode(F.sequence(F.lit(0), F.floor((F.col("_total") - length) / hop).cast("int"))))
    return df.select("stream", "window", F.expr(f"transform(sequence(0, {length - 1}), i -> samples[pmod(window * {hop} + i, _n)])").alias("values"))


def trailing(df: DataFrame, value: str, size: int, quantile: float | None = None) -> DataFrame:
    """``df`` with trailing: the minimum, or an exact quantile, of the last ``size`` rows. Blocks of a stream are windows of their own."""
    found = scans.trailing(df, value, size, F.min if quantile is None else lambda c: F.percentile(c, quantile))
    return found.withColumn("trailing", F.round("trailing", 6))


def recurrence(df: DataFrame, value: str, step: Callable[[list[float]], list[float]], name: str) -> DataFrame:
    """``step`` maps a stream's values, in order of n, to as many results: (stream, n, ``name``). Linear in the stream, which is held by one task, as
    each result needs the one before it."""

    def run(t: pa.Table) -> pa.Table:
        t = t.take(np.argsort(t.column("n").to_numpy(), kind="stable"))
        return t.select(["stream", "n"]).append_column(name, pa.array(step(t.column(value).to_pylist()), pa.float64()))

    kind = f"stream {df.schema['stream'].dataType.simpleString()}, n {df.schema['n'].dataType.simpleString()}, {name} double"
    return df.select("stream", "n", F.col(value).cast("double").alias(value)).groupBy("stream").applyInArrow(run, kind)


def ema(df: DataFrame, value: str, keep: float | Column) -> DataFrame:
    """(stream, n, ema): keep * before + (1 - keep) * now, from the first value; ``keep`` may be a column, as where it depends on a probability. A
    stream is run in blocks, on many tasks."""
    keep = keep if isinstance(keep, Column) else F.lit(float(keep))
    return scans.scan(df.select("stream", "n", F.col(value).alias("value"), keep.alias("keep")), scans.Average, "ema")


def asymmetric_ema(df: DataFrame, value: str, rising: float, falling: float, start: float) -> DataFrame:
    """(stream, n, floor): the same with another coefficient for values above the state than for others, from ``start``."""
    return scans.scan(df.select("stream", "n", F.col(value).alias("value")), scans.TwoRates(rising, falling, start), "floor")


def islands(df: DataFrame, label: str) -> DataFrame:
    """(stream, start, stop): half-open runs of labelled rows, by gaps and islands."""
    marked = df.withColumn("_i", F.col("n") - F.row_number().over(Window.partitionBy("stream", label).orderBy("n")))
    return marked.filter(F.col(label)).groupBy("stream", "_i").agg(F.min("n").alias("start"), (F.max("n") + 1).alias("stop")).drop("_i")


def segments(df: DataFrame, label: str, at: Framing, sizes: DataFrame) -> DataFrame:
    """Runs of labelled frames as sample intervals, cut at the stream's ``size``."""
    runs = islands(df, label).join(sizes, "stream")
    return runs.select("stream", (F.col("start") * at.hop).alias("start"), F.least("size", (F.col("stop") - 1) * at.hop + at.length).alias("stop"))


def drop_short(df: DataFrame, label: str, minimum: int) -> DataFrame:
    """``df`` with kept: the label, false in runs shorter than ``minimum``."""
    marked = df.withColumn("_i", F.col("n") - F.row_number().over(Window.partitionBy("stream", label).orderBy("n")))
    size = F.count("*").over(Window.partitionBy("stream", label, "_i"))
    return marked.withColumn("kept", F.col(label) & (size >= minimum)).drop("_i")


def interval_labels(frames: DataFrame, intervals: DataFrame, at: Framing) -> DataFrame:
    """``frames(stream, frame)`` with active: whether an interval (stream, start, stop) overlaps it. Intervals are dealt to the frames that they
    reach, so the range join is one on equal keys."""
    first = F.greatest(F.floor((F.col("start") - at.length) / at.hop) + 1, F.lit(0))
    reach = intervals.filter("stop > start").select("stream", F.explode(F.sequence(first, F.floor((F.col("stop") - 1) / at.hop))).alias("frame")).distinct()
    return frames.join(reach.withColumn("active", F.lit(True)), ["stream", "frame"], "left").withColumn("active", F.coalesce("active", F.lit(False)))


def residual_mix(strength: Column | float, enhanced: str = "enhanced", noisy: str = "noisy") -> Column:
    s = strength if isinstance(strength, Column) else F.lit(float(strength))
    return F.zip_with(enhanced, noisy, lambda e, x: s * e + (1 - s) * x)


def activity_mix(share: float, block: int, enhanced: str = "enhanced", noisy: str = "noisy", vad: str = "vad") -> Column:
    """Strength 1 - share * activity of each block; the last activity goes on."""
    return F.expr(f"transform({enhanced}, (e, i) -> (1 - {share}D * {vad}[least(cast(i div {block} as int), size({vad}) - 1)]) * e + {share}D * {vad}[least(cast(i div {block} as int), size({vad}) - 1)] * {noisy}[i])")


def delay_compensated(samples: str, delay: int) -> Column:
    """The first ``delay`` samples dropped, zeros appended."""
    return F.expr(f"transform({samples}, (x, i) -> coalesce(get({samples}, i + {delay}), cast(0 as double)))")


def clip_count(samples: str, at_one: bool = False) -> Column:
    return F.size(F.filter(samples, lambda x: (F.abs(x) >= 1) if at_one else (F.abs(x) > 1)))


def pcm16(samples: str) -> Column:
    return F.transform(samples, lambda x: F.bround(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) * 32767, 0).cast("int"))


def instantaneous_gain(power: Column, noise: Column, floor: float) -> Column:
    xi = F.greatest(F.least(power / F.greatest(noise, F.lit(1e-12)), F.lit(1e4)) - 1, F.lit(0.0))
    return F.greatest(F.lit(floor), F.least(F.lit(1.0), xi / (1 + xi)))


def subtraction_gain(power: Column, noise: Column, floor: float, over: float = 1.0) -> Column:
    kept = F.greatest(power - over * noise, floor * floor * power)
    return F.greatest(F.lit(floor), F.least(F.lit(1.0), F.sqrt(kept / (power + 1e-12))))


def oracle_gain(clean: Column, noise: Column) -> Column:
    return clean / (clean + noise + 1e-12)


def si_sdr(df: DataFrame, reference: str = "reference", estimate: str = "estimate") -> DataFrame:
    """``df(stream, reference, estimate)`` as (stream, si_sdr_db): means, then projection, then the residual in a pass of its own. A silent
    reference raises."""
    mean = lambda c: f"aggregate({c}, 0D, (a, x) -> a + x) / size({c})"
    df = df.withColumns({"_mr": F.expr(mean(reference)), "_me": F.expr(mean(estimate))})
    df = df.withColumns({"_r": F.expr(f"transform({reference}, x -> x - _mr)"), "_e": F.expr(f"transform({estimate}, x -> x - _me)")})
    dot = lambda a, b: F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, x) -> s + x)")
    df = df.withColumns({"_rr": dot("_r", "_r"), "_re": dot("_e", "_r")})
    df = df.withColumn("_k", F.when(F.col("_rr") > 1e-12, F.col("_re") / F.col("_rr")).otherwise(F.raise_error(F.lit("a silent reference")).cast("double")))
    rest = F.expr("aggregate(zip_with(_e, _r, (x, y) -> (x - _k * y) * (x - _k * y)), 0D, (s, x) -> s + x)")
    target = F.col("_k") * F.col("_k") * F.col("_rr")
    return df.select("stream", F.round(10 * F.log10((target + 1e-12) / (rest + 1e-12)), 6).alias("si_sdr_db"))


def _rows_of(column: pa.Array) -> Iterable[np.ndarray]:
    """The arrays of a list column, as views of its values; of a text column, the code points of one text after another."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return (np.frombuffer(x.as_py().decode("utf-8", "replace").encode("utf-32-le"), "<u4") for x in column.cast(pa.large_binary()))
    ends = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _column_of(values: list, kind: pa.DataType) -> pa.Array:
    """Scalars, arrays or matrices of equal kind as one Arrow array, without boxing their numbers."""
    if not pa.types.is_list(kind):
        return pa.array([v.item() if isinstance(v, np.generic) else v for v in values], kind)
    ends = pa.array(np.cumsum([0, *map(len, values)]), pa.int32())
    inner = kind.value_type
    if pa.types.is_list(inner):
        return pa.ListArray.from_arrays(ends, _column_of([row for v in values for row in v], inner)).cast(kind)
    flat = np.concatenate([np.asarray(v) for v in values if len(v)]) if any(len(v) for v in values) else np.zeros(0)
    return pa.ListArray.from_arrays(ends, pa.array(flat.tolist() if flat.dtype.kind in "OU" else flat).cast(inner)).cast(kind)


def per_stream(df: DataFrame, kernel: Callable[..., dict], outputs: dict[str, str], inputs: list[str] | None = None, keyed: bool = False) -> DataFrame:
    """A kernel over the arrays of each row: its results as columns (``outputs``: name to SQL type). Rows are independent, so no shuffle;
    arrays pass in Arrow batches, and texts as they are, for their code points. ``keyed`` gives the kernel the stream's key first."""
    each = lambda *rows: [kernel(*row) for row in zip(*rows)]
    return per_batch(df, each, outputs, inputs, keyed)


def per_batch(df: DataFrame, kernel: Callable[..., list[dict]], outputs: dict[str, str], inputs: list[str] | None = None, keyed: bool = False) -> DataFrame:
    """The same with a kernel that takes the arrays of all rows of a batch, a list for each input, and gives their results in order."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    inputs = inputs or ["samples"]
    kinds = {k: to_arrow_type(_parse_datatype_string(v)) for k, v in outputs.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [_rows_of(batch.column(k + 1)) for k in range(len(inputs))]
            keys = batch.column(0).to_pylist()
            rows = kernel(*([keys] if keyed else []), *arrays) if keys else []
            yield pa.RecordBatch.from_arrays([batch.column(0), *(_column_of([r[k] for r in rows], t) for k, t in kinds.items())], ["stream", *kinds])

    kind = f"stream {df.schema['stream'].dataType.simpleString()}, " + ", ".join(f"{k} {v}" for k, v in outputs.items())
    return df.select("stream", *inputs).mapInArrow(run, kind)


def enhance(df: DataFrame, method: str, at: Framing = Framing(), **settings) -> DataFrame:
    """(stream, samples, gain) of ``df(stream, samples)``; the streams of a batch are stepped side by side."""
    return per_batch(df, lambda xs: kernels.enhance_many(xs, method, at, **settings), {"samples": "array<double>", "gain": "array<array<double>>"})


def spectrum_power(df: DataFrame, at: Framing = Framing()) -> DataFrame:
    return per_stream(df, lambda x: {"power": np.abs(kernels.analyze(x, at)) ** 2}, {"power": "array<array<double>>"})


def with_windowed_sum(df: DataFrame, at: Framing) -> DataFrame:
    """Weighted overlap-add in SQL: (stream, n, value) from frame members with their window weights."""
    w = 0.5 - 0.5 * F.cos(2 * np.pi * F.col("offset") / at.length)
    parts = frame_members(df, at, at.length - at.hop).withColumns({"n": F.col("frame") * at.hop + F.col("offset") - (at.length - at.hop), "_w": w})
    return parts.groupBy("stream", "n").agg((F.sum(F.col("value") * F.col("_w")) / F.sum("_w")).alias("value")).filter("n >= 0")


def interpolate(points: DataFrame, at: DataFrame) -> DataFrame:
    """``at(stream, x)`` with y, linear between the neighbours in ``points(stream, x, y)``; before the first and after the last it stays at these.

    Both neighbours come from windows over the union, so there is no range join."""
    p = F.struct("x", "y")
    both = points.select("stream", "x", p.alias("p"), F.lit(0).alias("q")).unionByName(at.select("stream", "x", F.lit(None).cast(points.select(p).schema[0].dataType).alias("p"), F.lit(1).alias("q")))
    w = Window.partitionBy("stream").orderBy("x", "q")
    both = both.withColumns({"a": F.last("p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "b": F.first("p", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    blend = F.col("a.y") + (F.col("b.y") - F.col("a.y")) * (F.col("x") - F.col("a.x")) / (F.col("b.x") - F.col("a.x"))
    y = F.when(F.col("a").isNull(), F.col("b.y")).when(F.col("b").isNull() | (F.col("a.x") == F.col("x")), F.col("a.y")).otherwise(blend)
    return both.filter("q = 1").select("stream", "x", y.alias("y"))


def magnitude_gain(enhanced: Column, original: Column, floor: float) -> Column:
    ratio = F.when(F.abs(original) > 1e-12, F.abs(enhanced) / F.abs(original)).otherwise(1.0)
    return F.greatest(F.lit(floor), F.least(F.lit(1.0), ratio))


def calibrated(raw: Column, coefficients: list[float]) -> Column:
    """A polynomial, highest power first."""
    out = F.lit(0.0)
    for c in coefficients:
        out = out * raw + c
    return out


def zip_positions(left: DataFrame, right: DataFrame, by: str, order: str, columns: list[str]) -> DataFrame:
    """Rows of one place in both tables' order within ``by``; different lengths raise."""
    w = Window.partitionBy(by).orderBy(order)
    place = F.row_number().over(w)
    a, b = left.withColumn("_k", place), right.select(by, order, *columns).withColumn("_k", place).drop(order).withColumn("_b", F.lit(1))
    joined = a.withColumn("_a", F.lit(1)).join(b, [by, "_k"], "full_outer")
    whole = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("both sides must have one length")).cast("int")).otherwise(F.col("_k"))
    return joined.withColumn("place", whole).drop("_k", "_a", "_b")
