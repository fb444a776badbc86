"""Stateful operators on chunked streams, on ``transformWithState``: numbers in the state store, no code.

A chunk is (stream, seq, values, last): values in order, ``last`` the stream's end marker, which flushes. Chunks may arrive in any
order within and across micro-batches: those ahead of their turn wait in the stream's state, at most ``WAITING`` of them; a repeated seq raises.
A stream's state is one value, read and written once a micro-batch with all that waits.
A stream's state is removed at its end. Where ``idle`` is given, a stream that has been silent for so long (a timer) is flushed and removed as if it had
ended; such a query looks for silent streams without new data too, so it doesn't end by itself.

What an operator carries from chunk to chunk are named arrays and counts (``Memory``), whose size doesn't grow with the stream; a query that is started again with other code
goes on with them. This kind of state needs the RocksDB store, which ``streamed`` sets for its session.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import endpointing, kernels, recurrent
from ..functions.settings import Endpoints, Framing

WAITING = 10_000
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHUNK = "stream long, seq long, values array<double>, last boolean, ts timestamp"
SAMPLES = "stream long, seq long, samples array<double>"
FRAMES = "stream long, seq long, samples array<double>, activity array<double>"
SEGMENTS = "stream long, start_frame long, end_frame long, speech_frames long, total_frames long, reason string"
Memory = tuple[dict[str, list[float]], dict[str, int]]


class Samples:
    """Chunks of samples through a kernel with push and maybe flush. ``carried`` names its arrays and counts, with dots to those of its parts."""

    columns = ("seq", "samples")

    def __init__(self, kernel):
        self.kernel = kernel

    def push(self, seq: int, values) -> list[tuple]:
        return [(seq, self.kernel.push(values).tolist())]

    def flush(self, seq: int) -> list[tuple]:
        return [(seq, self.kernel.flush().tolist())] if hasattr(self.kernel, "flush") else []

    def _owner(self, name: str) -> tuple:
        owner = self.kernel
        *way, last = name.split(".")
        for part in way:
            owner = getattr(owner, part)
        return owner, last

    def memory(self) -> Memory:
        arrays, counts = ([(n, getattr(*self._owner(n))) for n in names] for names in self.kernel.carried)
        return {n: np.asarray(v, float).tolist() for n, v in arrays}, {n: int(v) for n, v in counts}

    def recall(self, memory: Memory) -> None:
        for n, v in memory[0].items():
            setattr(*self._owner(n), np.array(v, float))
        for n, v in memory[1].items():
            setattr(*self._owner(n), int(v))


class Frames(Samples):
    """The same of a frame model, with the activities of the frames that a chunk completes."""

    columns = ("seq", "samples", "activity")

    def _row(self, seq: int, samples) -> list[tuple]:
        return [(seq, samples.tolist(), self.kernel.activities.tolist())]

    def push(self, seq: int, values) -> list[tuple]:
        return self._row(seq, self.kernel.push(values))

    def flush(self, seq: int) -> list[tuple]:
        return self._row(seq, self.kernel.flush())


class Segments:
    """Chunks of activity, one value for each frame, to segments."""

    columns = endpointing.Segment._fields
    counts = ("frame", "since", "begin", "onsets", "silent", "speech")

    def __init__(self, config: Endpoints):
        self.config, self.live = config, endpointing.Live()

    def push(self, seq: int, values) -> list[tuple]:
        self.live, out = endpointing.read(self.live, values, self.config)
        return [tuple(s) for s in out]

    def flush(self, seq: int) -> list[tuple]:
        return [tuple(s) for s in endpointing.ended(self.live, self.config)]

    def memory(self) -> Memory:
        return {"recent": self.live.recent.astype(float).tolist()}, {n: getattr(self.live, n) for n in self.counts}

    def recall(self, memory: Memory) -> None:
        self.live = endpointing.Live(**memory[1], recent=np.array(memory[0]["recent"], bool))


class Through48k:
    """Three times the rate, a frame model at it (samples to samples, of any chunk), and back; ends with the delay's tail."""

    carried = ("up.tail", "down.tail"), ("down.total",)

    def __init__(self, model: Callable[[np.ndarray], np.ndarray] = lambda x: x):
        self.up, self.down, self.model, self.delay = kernels.TripleUp(), kernels.TripleDown(), model, 42

    def push(self, values) -> np.ndarray:
        return self.down.push(self.model(self.up.push(values)))

    def flush(self) -> np.ndarray:
        return self.push(np.zeros(self.delay))


class Blocks:
    """A model of whole blocks fed by chunks of any size: the last block is padded, the output as long as the input."""

    carried = ("held",), ("taken", "given")

    def __init__(self, model: Callable[[np.ndarray], np.ndarray], size: int = 480):
        self.model, self.size, self.held, self.taken, self.given = model, size, np.zeros(0), 0, 0

    def push(self, values) -> np.ndarray:
        self.held = np.concatenate([self.held, np.asarray(values, float)])
        self.taken += len(values)
        out = [np.zeros(0)]
        while len(self.held) >= self.size:
            out.append(self.model(self.held[: self.size]))
            self.held = self.held[self.size :]
        self.given += sum(map(len, out))
        return np.concatenate(out)

    def flush(self) -> np.ndarray:
        left = self.taken - self.given
        return self.push(np.zeros(-len(self.held) % self.size))[:left] if left else np.zeros(0)


class Waiting:
    """Chunks ahead of their turn."""

    def __init__(self):
        self.held: dict = {}

    def contains(self, seq: int) -> bool:
        return seq in self.held

    def put(self, seq: int, values, last: bool) -> None:
        self.held[seq] = (values, last)

    def take(self, seq: int):
        return self.held.pop(seq)


PACKED = "{0}seqs array<long>, {0}sizes array<long>, {0}lasts array<boolean>, {0}values array<double>"


def packed(waiting: Waiting) -> tuple:
    """What waits as one row of ``PACKED``, so that a stream's state is read and written once a micro-batch, not once a chunk; chunks without values have size -1."""
    held = waiting.held
    rows = [None if v is None else np.asarray(v, float) for v, _ in held.values()]
    values = [r for r in rows if r is not None]
    return list(held), [-1 if r is None else len(r) for r in rows], [bool(last) for _, last in held.values()], np.concatenate(values).tolist() if values else []


def unpacked(seqs, sizes, lasts, values) -> Waiting:
    waiting, at, values = Waiting(), 0, np.array(values, float)
    for seq, size, last in zip(seqs, sizes, lasts):
        waiting.put(int(seq), None if size < 0 else values[at : at + size], bool(last))
        at += max(int(size), 0)
    return waiting


class Turn:
    """Whose turn it is, how many wait, and whether the stream has ended."""

    def __init__(self, stream, waiting, following: int = 0, ahead: int = 0):
        self.stream, self.waiting, self.following, self.ahead, self.ended = stream, waiting, following, ahead, False

    def arrived(self, rows: list[tuple]) -> Iterator[tuple[int, np.ndarray | None, bool]]:
        """The chunks whose turn has come, in order, up to the last one; others wait. Repeated chunks and those beyond the end raise."""
        for seq, values, last in rows:
            if self.ended or seq < self.following or self.waiting.contains(seq):
                raise ValueError(f"stream {self.stream}: chunk {seq} came twice or after the end")
            self.waiting.put(seq, values, last)
            self.ahead += 1
            while not self.ended and self.ahead and self.waiting.contains(self.following):
                values, last = self.waiting.take(self.following)
                yield self.following, None if values is None or not len(values) else np.asarray(values, float), bool(last)
                self.ahead, self.following, self.ended = self.ahead - 1, self.following + 1, bool(last)
            if self.ahead > WAITING:
                raise ValueError(f"stream {self.stream}: too many chunks wait for chunk {self.following}")
        if self.ended and self.ahead:
            raise ValueError(f"stream {self.stream}: chunks came after the end")


def _advance(operator, turn: Turn, rows: list[tuple]) -> list[tuple]:
    out = []
    for seq, values, last in turn.arrived(rows):
        if values is not None:
            out += operator.push(seq, values)
        if last:
            out += operator.flush(seq + 1)
    return out


def _rows(pdf: pd.DataFrame) -> list[tuple]:
    return list(zip(pdf["seq"].tolist(), pdf["values"], pdf["last"].fillna(False).astype(bool).tolist()))


class Ordered(StatefulProcessor):
    """An operator for each stream of a streaming table."""

    def __init__(self, make: Callable, columns: tuple[str, ...], idle: int | None):
        self.make, self.columns, self.idle = make, columns, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", f"following long, arrays map<string,array<double>>, counts map<string,long>, {PACKED.format('')}")

    def _table(self, out: list[tuple], stream) -> pd.DataFrame:
        return pd.DataFrame({"stream": [stream] * len(out)} | dict(zip(self.columns, map(list, zip(*out)))))

    def _held(self) -> tuple | None:
        """(operator, whose turn it is, what waits) of a stream that is known."""
        held = self.state.get()
        if held is None:
            return None
        following, arrays, counts, *waiting = held
        operator = self.make()
        operator.recall(({k: list(v) for k, v in arrays.items()}, dict(counts)))
        return operator, following, unpacked(*waiting)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        operator, following, waiting = self._held() or (self.make(), 0, Waiting())
        turn = Turn(key[0], waiting, following, len(waiting.held))
        out = []
        for pdf in rows:
            out += _advance(operator, turn, _rows(pdf))
        if self.idle:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
        if turn.ended:
            self.state.clear()
        else:
            self.state.update((turn.following, *operator.memory(), *packed(waiting)))
            if self.idle:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        if out:
            yield self._table(out, key[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        if held:
            operator, following, _ = held
            out = operator.flush(following)
            self.state.clear()
            if out:
                yield self._table(out, key[0])

    def close(self) -> None:
        pass


def streamed(chunks: DataFrame, make: Callable, shape: str, columns: tuple[str, ...], idle: int | None = None) -> DataFrame:
    """The operator that ``make`` builds, for each stream of a streaming table; ``idle`` in milliseconds."""
    chunks.sparkSession.conf.set(STORE, ROCKS)
    return chunks.groupBy("stream").transformWithStateInPandas(Ordered(make, columns, idle), shape, "Append", "ProcessingTime" if idle else "None")


def batched(chunks: DataFrame, make: Callable, shape: str, columns: tuple[str, ...]) -> DataFrame:
    """The same on a finished table."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = _advance(make(), Turn(key[0], Waiting()), _rows(pdf.sort_values("seq")))
        return pd.DataFrame(out, columns=list(columns)).assign(stream=key[0])[["stream", *columns]]

    return chunks.groupBy("stream").applyInPandas(run, shape)


def _either(chunks: DataFrame, make: Callable, shape: str, columns: tuple[str, ...]) -> DataFrame:
    return (streamed if chunks.isStreaming else batched)(chunks, make, shape, columns)


def overlap_add(chunks: DataFrame, at: Framing = Framing(), processor: Callable = lambda s: s) -> DataFrame:
    """Windowed analysis, ``processor`` of each spectrum, synthesis: (stream, seq, samples), in total as long as the input."""
    return _either(chunks, lambda: Samples(kernels.StreamingOverlapAdd(at, processor)), SAMPLES, Samples.columns)


def upsample3(chunks: DataFrame) -> DataFrame:
    return _either(chunks, lambda: Samples(kernels.TripleUp()), SAMPLES, Samples.columns)


def downsample3(chunks: DataFrame) -> DataFrame:
    return _either(chunks, lambda: Samples(kernels.TripleDown()), SAMPLES, Samples.columns)


def through_48k(chunks: DataFrame, model: Callable = lambda x: x) -> DataFrame:
    return _either(chunks, lambda: Samples(Through48k(model)), SAMPLES, Samples.columns)


def block_model(chunks: DataFrame, model: Callable, size: int = 480) -> DataFrame:
    return _either(chunks, lambda: Samples(Blocks(model, size)), SAMPLES, Samples.columns)


def model_weights(table: DataFrame) -> dict[str, np.ndarray]:
    """name to values, of ``table(name, place, value)``: a model's weights, which every task holds. Places that are missing or repeated raise."""
    out = {}
    for r in table.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("v")).collect():
        if [x.place for x in r.v] != list(range(len(r.v))):
            raise ValueError(f"{r.name}: places must be whole numbers from 0, each once")
        out[r.name] = np.array([x.value for x in r.v], float)
    return out


def frame_model(chunks: DataFrame, model: recurrent.FrameModel, weights: dict[str, np.ndarray]) -> DataFrame:
    """Chunks through a recurrent frame model: (stream, seq, samples, activity), samples in total as many as came in, an activity for each frame, and one more that the end's silence makes."""
    return _either(chunks, lambda: Frames(recurrent.FrameState(model, weights)), FRAMES, Frames.columns)


def endpoints(chunks: DataFrame, config: Endpoints = Endpoints()) -> DataFrame:
    """Activity chunks to segments (stream, start_frame, end_frame, speech_frames, total_frames, reason)."""
    return _either(chunks, lambda: Segments(config), SEGMENTS, Segments.columns)


def as_chunks(long: DataFrame, size: int) -> DataFrame:
    """(stream, n, value) in chunks of ``size``, the last marked."""
    parts = long.groupBy("stream", F.floor(F.col("n") / size).alias("seq")).agg(F.array_sort(F.collect_list(F.struct("n", "value"))).alias("a"))
    ends = long.groupBy("stream").agg(F.floor(F.max("n") / size).alias("_end"))
    return parts.join(ends, "stream").select("stream", "seq", F.transform("a", lambda x: x["value"]).alias("values"), (F.col("seq") == F.col("_end")).alias("last"), F.lit(None).cast("timestamp").alias("ts"))
