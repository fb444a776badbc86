"""Live pipelines on streams: frames met with their activity, a bounded queue of jobs, and a worker's sink that a repeated batch doesn't change."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .chunks import PACKED, ROCKS, STORE, Turn, Waiting, _either, packed, unpacked

SIDES = ("samples", "activity")
ALIGNED = "stream long, frame long, activity double, samples array<double>"
JOBS = "stream long, seq long, dropped boolean, queue_seconds double, work_seconds double, end_to_text_seconds double"


class Pairing:
    """Samples and activity of one stream: ``size`` samples to each activity. What one side has ahead of the other waits."""

    def __init__(self, size: int):
        self.size, self.frame = size, 0
        self.held = {side: np.zeros(0) for side in SIDES}

    def push(self, side: str, values: np.ndarray) -> None:
        self.held[side] = np.concatenate([self.held[side], values])

    def pairs(self) -> list[tuple]:
        samples, activity = (self.held[side] for side in SIDES)
        n = min(len(samples) // self.size, len(activity))
        out = [(self.frame + i, float(activity[i]), samples[i * self.size : (i + 1) * self.size].tolist()) for i in range(n)]
        self.held = {"samples": samples[n * self.size :], "activity": activity[n:]}
        self.frame += n
        return out

    def ahead(self) -> int:
        """Frames that one side has ahead."""
        return max(-(-len(self.held["samples"]) // self.size), len(self.held["activity"]))


class AlignedStreams(StatefulProcessor):
    def __init__(self, size: int, ahead: int):
        self.size, self.ahead = size, ahead

    def init(self, handle: StatefulProcessorHandle) -> None:
        turn = ", ".join(f"{side}_following long, {side}_ended boolean, {PACKED.format(f'{side}_')}" for side in SIDES)
        self.state = handle.getValueState("state", f"frame long, samples array<double>, activity array<double>, {turn}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pairing = Pairing(self.size)
        turns = {side: Turn(key[0], Waiting()) for side in SIDES}
        held = self.state.get()
        if held is not None:
            pairing.frame, samples, activity = held[:3]
            pairing.held = {"samples": np.array(samples, float), "activity": np.array(activity, float)}
            for k, side in enumerate(SIDES):
                following, ended, *waiting = held[3 + 6 * k : 9 + 6 * k]
                waiting = unpacked(*waiting)
                turns[side] = Turn(key[0], waiting, following, len(waiting.held))
                turns[side].ended = ended
        out = _paired(pairing, turns, rows, key[0])
        if pairing.ahead() > self.ahead:
            raise ValueError(f"stream {key[0]}: one side is {pairing.ahead()} frames ahead")
        if all(t.ended for t in turns.values()):
            self.state.clear()
        else:
            sides = (x for t in turns.values() for x in (t.following, t.ended, *packed(t.waiting)))
            self.state.update((pairing.frame, *(pairing.held[side].tolist() for side in SIDES), *sides))
        if out:
            yield _aligned_rows(out, key[0])

    def close(self) -> None:
        pass


def _paired(pairing: Pairing, turns: dict[str, Turn], tables, stream) -> list[tuple]:
    for pdf in tables:
        for side in SIDES:
            own = pdf[pdf["side"] == side]
            rows = list(zip(own["seq"].tolist(), own["values"], own["last"].fillna(False).astype(bool).tolist()))
            for _, values, _ in turns[side].arrived(rows):
                if values is not None:
                    pairing.push(side, values)
    out = pairing.pairs()
    if all(t.ended for t in turns.values()) and pairing.ahead():
        raise ValueError(f"stream {stream}: {len(pairing.held['samples'])} samples and {len(pairing.held['activity'])} activities have no counterpart")
    return out


def _aligned_rows(out: list[tuple], stream) -> pd.DataFrame:
    return pd.DataFrame(out, columns=["frame", "activity", "samples"]).assign(stream=stream)[["stream", "frame", "activity", "samples"]]


def aligned(samples: DataFrame, activity: DataFrame, size: int = 160, ahead: int = 1000) -> DataFrame:
    """(stream, frame, activity, samples): each activity with its ``size`` samples, of two chunk tables (see ``chunks``), both streams or both finished. Either side may come first, by at most ``ahead``
    frames after a micro-batch; where both have ended, samples or activities without counterpart raise."""
    both = None
    for side, df in zip(SIDES, (samples, activity)):
        own = df.select("stream", F.lit(side).alias("side"), "seq", "values", "last")
        both = own if both is None else both.unionByName(own)
    if both.isStreaming:
        both.sparkSession.conf.set(STORE, ROCKS)
        return both.groupBy("stream").transformWithStateInPandas(AlignedStreams(size, ahead), ALIGNED, "Append", "None")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        turns = {side: Turn(key[0], Waiting()) for side in SIDES}
        return _aligned_rows(_paired(Pairing(size), turns, [pdf.sort_values("seq")], key[0]), key[0])

    return both.groupBy("stream").applyInPandas(run, ALIGNED)


class Queue:
    """One worker behind a queue for ``capacity`` jobs. A chunk is a job: when it arrives and how long its work takes, in seconds, in the order of arrival. A job that finds the queue full is
    dropped; others start when the worker is free."""

    columns = ("seq", "dropped", "queue_seconds", "work_seconds", "end_to_text_seconds")

    def __init__(self, capacity: int):
        self.capacity, self.free, self.starts, self.dropped = capacity, 0.0, [], 0

    def push(self, seq: int, values) -> list[tuple]:
        arrives, work = float(values[0]), float(values[1])
        self.starts = [s for s in self.starts if s > arrives]  # of those that still wait
        if len(self.starts) >= self.capacity:
            self.dropped += 1
            return [(seq, True, None, work, None)]
        start = max(arrives, self.free)
        self.free = start + work
        self.starts.append(start)
        return [(seq, False, start - arrives, work, self.free - arrives)]

    def flush(self, seq: int) -> list[tuple]:
        return []

    def memory(self):
        return {"starts": self.starts, "free": [self.free]}, {"dropped": self.dropped}

    def recall(self, memory) -> None:
        self.starts, (self.free,), self.dropped = list(memory[0]["starts"]), memory[0]["free"], memory[1]["dropped"]


def queued(jobs: DataFrame, capacity: int = 4) -> DataFrame:
    """(stream, seq, dropped, queue_seconds, work_seconds, end_to_text_seconds) of a chunk table whose values are a job's arrival and work; null latencies
    where a job is dropped. State is at most ``capacity`` numbers and three more for each stream."""
    return _either(jobs, lambda: Queue(capacity), JOBS, Queue.columns)


def worked(jobs: DataFrame, load: Callable[[], Callable[[list], list]]) -> DataFrame:
    """``jobs(stream, seq, input, ended)`` with text, error, queue_seconds, work_seconds and end_to_text_seconds. ``load`` is called once for each task and gives the model, inputs to texts; an exception of
    one job is its error and doesn't end the others. ``ended`` is when the job's input was whole, in seconds since 1970."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            out = []
            for given, ended in zip(batch.column("input").to_pylist(), batch.column("ended").to_pylist()):
                began, text, error = time.time(), None, None
                try:
                    text = model([given])[0]
                except Exception as e:  # noqa: BLE001  # the job's result
                    error = f"{type(e).__name__}: {e}"
                now = time.time()
                out.append((text, error, began - ended, now - began, now - ended))
            names = ("text", "error", "queue_seconds", "work_seconds", "end_to_text_seconds")
            kinds = (pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64())
            columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("stream"), batch.column("seq"), *columns], ["stream", "seq", *names])

    shape = "stream long, seq long, text string, error string, queue_seconds double, work_seconds double, end_to_text_seconds double"
    return jobs.select("stream", "seq", "input", "ended").mapInArrow(run, shape)


class Ledger:
    """A sink for ``foreachBatch``: each micro-batch goes through ``work``, and its rows and then its entry are written below a shared folder under its number. A batch that has its entry is left
    alone; one that failed before its entry is written over. So a batch that comes again adds no rows."""

    def __init__(self, folder: str, work: Callable[[DataFrame], DataFrame]):
        self.folder, self.work = folder.rstrip("/"), work

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        entry = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/ledger/batch={number}/_SUCCESS")
        if entry.getFileSystem(spark._jsc.hadoopConfiguration()).exists(entry):
            return
        rows = f"{self.folder}/rows/batch={number}"
        self.work(batch).write.mode("overwrite").parquet(rows)
        seconds = [F.max(c).alias(f"most_{c}") for c in ("queue_seconds", "work_seconds", "end_to_text_seconds")]
        written = spark.read.parquet(rows)
        found = written.agg(F.count("*").alias("jobs"), F.count("error").alias("errors"), *seconds)
        found.write.mode("overwrite").parquet(f"{self.folder}/ledger/batch={number}")

    def rows(self, spark) -> DataFrame:
        """Of the batches that have their entries."""
        return spark.read.parquet(f"{self.folder}/rows").join(self.entries(spark).select("batch"), "batch", "left_semi")

    def entries(self, spark) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/ledger")
