"""Live operators: endpoints, alignment and queue against plain ones, chunked and out of order, with restarts and repeated batches."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from frameloom.functions import endpointing
from frameloom.functions.settings import Endpoints, milliseconds_to_frames
from frameloom.streaming import chunks, live


def frame_by_frame(activity, c):
    """The same rules for one frame at a time."""
    out, open_, before, on = [], None, [], 0
    for i, p in enumerate(activity):
        loud = p >= c.off
        if open_ is None:
            before = (before + [(i, loud)])[-(c.preroll + c.onset) :]
            on = on + 1 if p >= c.on else 0
            if on < c.onset:
                continue
            open_, quiet, reason = before, 0, None
        else:
            open_.append((i, loud))
            quiet = 0 if loud else quiet + 1
            reason = "silence" if quiet >= c.hangover else None
        reason = reason or ("maximum_duration" if len(open_) >= c.maximum else None)
        if reason:
            out.append((open_, reason))
            open_, before, on = None, [], 0
    if open_ is not None:
        out.append((open_, "stream_end"))
    found = [(s[0][0], s[-1][0] + 1, sum(x for _, x in s), len(s), reason) for s, reason in out]
    return [s for s in found if s[2] >= c.least_speech]


def configs(n=60):
    rng = random.Random(9)
    for _ in range(n):
        off = rng.choice([0.2, 0.5])
        yield Endpoints(rng.choice([off, 0.6]), off, rng.randint(1, 4), rng.randint(1, 6), rng.randint(0, 5), rng.randint(0, 5), rng.choice([1, 3, 8, 30])), rng


def test_endpoints_equal_a_plain_machine_in_any_chunks():
    for c, rng in configs():
        p = [rng.choice([0.0, 0.1, 0.3, 0.55, 0.9]) if rng.random() < 0.5 else 0.9 * (i // 13 % 2) for i in range(rng.choice([0, 1, 5, 120]))]
        want = frame_by_frame(p, c)
        assert endpointing.segments(p, c) == want
        s, got, at = endpointing.Live(), [], 0
        while at < len(p):
            n = rng.randint(1, 9)
            s, found = endpointing.read(s, p[at : at + n], c)
            got, at = got + found, at + n
            assert len(s.recent) <= c.preroll + c.onset
        assert got + endpointing.ended(s, c) == want


def test_milliseconds():
    assert [milliseconds_to_frames(x) for x in (0.1, 10, 10.5, 700)] == [1, 1, 2, 70]
    assert Endpoints.from_milliseconds(hangover=15.5).hangover == 2
    with pytest.raises(ValueError):
        milliseconds_to_frames(0)


def streams(k=5):
    rng = random.Random(3)
    return {s: [rng.choice([0.1, 0.4, 0.8]) if rng.random() < 0.6 else 0.8 for _ in range(rng.choice([30, 61, 97]))] for s in range(k)}


def chunk_rows(values, size):
    return [(s, i // size, v[i : i + size], i + size >= len(v), None) for s, v in values.items() for i in range(0, len(v), size)]


def written(spark, rows, path, parts):
    random.Random(4).shuffle(rows)
    for k in range(parts):
        spark.createDataFrame(rows[k::parts], chunks.CHUNK).coalesce(1).write.mode("append").parquet(path)


def run(df, path, **more):
    q = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out").trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    return q


def test_streamed_endpoints_go_on_after_a_restart_with_other_code(spark, tmp_path):
    c = Endpoints(0.6, 0.3, 2, 3, 2, 1, 20)
    values = streams()
    rows = chunk_rows(values, 7)
    source = f"{tmp_path}/in"
    random.Random(4).shuffle(rows)
    first, second = rows[: len(rows) // 2], rows[len(rows) // 2 :]
    written(spark, first, source, 2)

    def started():
        read = spark.readStream.schema(chunks.CHUNK).option("maxFilesPerTrigger", 1).parquet(source)
        return chunks.endpoints(read, c)

    run(started(), tmp_path)
    written(spark, second, source, 2)
    changed = type("Segments", (chunks.Segments,), {"added": 1})  # what makes the operator isn't what the state holds
    read = spark.readStream.schema(chunks.CHUNK).option("maxFilesPerTrigger", 1).parquet(source)
    q = run(chunks.streamed(read, lambda: changed(c), chunks.SEGMENTS, changed.columns), tmp_path)
    got = spark.read.schema(chunks.SEGMENTS).parquet(f"{tmp_path}/out").collect()
    assert sorted(tuple(r) for r in got) == sorted((s, *f) for s, v in values.items() for f in frame_by_frame(v, c))
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 0
    batch = chunks.endpoints(spark.createDataFrame(rows, chunks.CHUNK), c).collect()
    assert sorted(map(tuple, batch)) == sorted(map(tuple, got))


def test_aligned_sides_meet_in_any_order(spark, tmp_path):
    rng = random.Random(6)
    activity = {s: [rng.random() for _ in range(n)] for s, n in enumerate((9, 30, 1))}
    samples = {s: [rng.random() for _ in range(4 * len(v))] for s, v in activity.items()}
    want = sorted((s, i, v[i], samples[s][4 * i : 4 * i + 4]) for s, v in activity.items() for i in range(len(v)))
    a, b = chunk_rows(samples, 10), chunk_rows(activity, 3)
    batch = live.aligned(spark.createDataFrame(a, chunks.CHUNK), spark.createDataFrame(b, chunks.CHUNK), 4)
    assert sorted(tuple(r) for r in batch.collect()) == want
    written(spark, a, f"{tmp_path}/a", 3)
    written(spark, b, f"{tmp_path}/b", 2)
    sides = [spark.readStream.schema(chunks.CHUNK).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{x}") for x in "ab"]
    q = run(live.aligned(*sides, 4), tmp_path)
    assert sorted(tuple(r) for r in spark.read.schema(live.ALIGNED).parquet(f"{tmp_path}/out").collect()) == want
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 0


def test_sides_that_do_not_match_raise(spark, tmp_path):
    samples, short, long = (spark.createDataFrame(chunk_rows({1: [0.5] * n}, 5), chunks.CHUNK) for n in (40, 9, 11))
    for activity in (short, long):
        with pytest.raises(Exception, match="no counterpart"):
            live.aligned(samples, activity, 4).collect()
    samples.coalesce(1).write.parquet(f"{tmp_path}/a")
    short.limit(0).coalesce(1).write.parquet(f"{tmp_path}/b")
    sides = [spark.readStream.schema(chunks.CHUNK).parquet(f"{tmp_path}/{x}") for x in "ab"]
    with pytest.raises(Exception, match="frames ahead"):
        run(live.aligned(*sides, 4, ahead=9), tmp_path)


def plain_queue(jobs, capacity):
    """Second by second of events: arrivals and ends of work."""
    pending, busy_until, out = [], None, {}
    for k, (arrives, work) in enumerate(jobs):
        while busy_until is not None and busy_until <= arrives:
            at = busy_until
            busy_until = None
            if pending:
                j = pending.pop(0)
                out[j] = at - jobs[j][0], jobs[j][1]
                busy_until = at + jobs[j][1]
        if busy_until is None:
            out[k], busy_until = (0.0, work), arrives + work
        elif len(pending) < capacity:
            pending.append(k)
        else:
            out[k] = None
    while pending:
        j = pending.pop(0)
        out[j] = busy_until - jobs[j][0], jobs[j][1]
        busy_until += jobs[j][1]
    return out


@pytest.mark.parametrize("capacity", [1, 4])
def test_queue_drops_what_a_plain_one_drops(spark, capacity):
    rng = random.Random(capacity)
    jobs = {s: [(float(i) + rng.random() / 2, rng.choice([0.25, 1.5, 6.0])) for i in range(80)] for s in range(3)}
    rows = [(s, i, list(j), False, None) for s, v in jobs.items() for i, j in enumerate(v)]
    got = live.queued(spark.createDataFrame(rows, chunks.CHUNK), capacity).collect()
    assert len(got) == 240 and any(r.dropped for r in got)
    for s, v in jobs.items():
        want = plain_queue(v, capacity)
        for r in (r for r in got if r.stream == s):
            assert r.dropped == (want[r.seq] is None)
            if want[r.seq]:
                waits, work = want[r.seq]
                assert (r.queue_seconds, r.work_seconds, r.end_to_text_seconds) == (pytest.approx(waits, abs=1e-9), work, pytest.approx(waits + work))


def test_repeated_batches_add_no_rows(spark, tmp_path):
    calls = []

    def work(batch):
        calls.append(1)
        return live.worked(batch, lambda: lambda xs: [x.upper() for x in xs])

    sink = live.Ledger(tmp_path.as_uri(), work)
    jobs = spark.createDataFrame([(1, i, x, 1.0) for i, x in enumerate(["a", None, "c"])], "stream long, seq long, input string, ended double")
    sink(jobs, 0)
    sink(jobs, 0)
    sink(jobs.limit(1), 1)
    (tmp_path / "ledger" / "batch=1" / "_SUCCESS").unlink()  # as if it had failed before its entry
    sink(jobs.limit(1), 1)
    rows = sink.rows(spark).collect()
    assert sorted((r.batch, r.seq, r.text) for r in rows if r.error is None) == [(0, 0, "A"), (0, 2, "C"), (1, 0, "A")] and len(calls) == 3
    assert [r.error for r in rows if r.error] == ["AttributeError: 'NoneType' object has no attribute 'upper'"]
    assert all(abs(r.end_to_text_seconds - r.queue_seconds - r.work_seconds) < 1e-6 and r.queue_seconds > 0 for r in rows)
    assert {(r.batch, r.jobs, r.errors) for r in sink.entries(spark).collect()} == {(0, 3, 1), (1, 1, 0)}


class CountedState:
    """A handle of one key, whose states count what is asked of them."""

    def __init__(self):
        self.asked, self.values, self.entries = 0, {}, {}

    def getValueState(self, name, schema):
        return self.view(lambda: self.values.get(name), lambda v: self.values.update({name: v}), lambda: self.values.pop(name, None), lambda: name in self.values)

    def getMapState(self, name, key, schema):
        return self.view(self.entries.get, self.entries.__setitem__, self.entries.clear)

    def view(self, get, put, clear, exists=None):
        def counted(f):
            def run(*args):
                self.asked += 1
                return f(*args)

            return run

        names = {"get": get, "update": put, "clear": clear, "getValue": get, "updateValue": put, "containsKey": lambda k: k in self.entries, "removeKey": self.entries.pop, "exists": exists}
        return type("State", (), {k: staticmethod(counted(f)) for k, f in names.items()})()


def test_state_is_asked_once_a_batch_and_not_once_a_chunk():
    values = [float(i) for i in range(200)]
    rows = [(i // 2, values[i : i + 2], i + 2 >= len(values)) for i in range(0, len(values), 2)]
    handle, got = CountedState(), []
    operator = chunks.Ordered(lambda: chunks.Samples(chunks.Blocks(lambda b: 2 * b, 12)), chunks.Samples.columns, None)
    operator.init(handle)
    for part in (rows[1::3], rows[2::3], rows[::3]):
        for pdf in operator.handleInputRows((1,), iter([pd.DataFrame(part, columns=["seq", "values", "last"])]), None):
            got += [v for x in pdf.sort_values("seq")["samples"] for v in x]
    assert got == [2 * v for v in values] and not handle.values
    assert handle.asked <= 6


def test_what_waits_is_packed_whole():
    waiting = chunks.Waiting()
    for seq, values, last in ((7, [1.0, 2.0], False), (3, None, False), (5, [], True)):
        waiting.put(seq, values, last)
    back = chunks.unpacked(*chunks.packed(waiting)).held
    assert {k: (None if v is None else list(v), last) for k, (v, last) in back.items()} == {7: ([1.0, 2.0], False), 3: (None, False), 5: ([], True)}
