"""Model fronts against plain loops: the recurrent frame model, sub-band activity, perceived quality and its mel front end."""

import math
import random

import numpy as np
import pytest

from frameloom.functions import recurrent, subbands
from frameloom.operators import perceived
from frameloom.streaming import chunks

MODEL = recurrent.FrameModel(frame=16, bands=4, hidden=5, shortest=3, longest=24)


def random_weights(m=MODEL, seed=4):
    rng = np.random.default_rng(seed)
    return {name: rng.normal(size=m.shape(name)) * 0.6 for name in recurrent.SHAPES}


def plain_frames(x, m, w):
    """(output, activities) of whole frames, number by number."""
    n, bins = m.frame, m.frame + 1
    peaks = [(bins - 1) * (k / (m.bands - 1)) ** 2 for k in range(m.bands)]

    def share(k, i):
        if k and peaks[k - 1] <= i <= peaks[k]:
            return (i - peaks[k - 1]) / (peaks[k] - peaks[k - 1])
        if k + 1 < m.bands and peaks[k] <= i <= peaks[k + 1]:
            return (peaks[k + 1] - i) / (peaks[k + 1] - peaks[k])
        return 0.0

    squash = lambda v: 1 / (1 + math.exp(-v))
    dense = lambda name, v, k: sum(v[i] * w[name][i][k] for i in range(len(v)))
    window = [math.sin(math.pi * (i + 0.5) / (2 * n)) for i in range(2 * n)]
    padded = [0.0] * m.reach + list(x)
    h, before, tail, out, activities = [0.0] * m.hidden, [0.0] * m.bands, [0.0] * n, [], []
    for f in range(len(x) // n):
        past = padded[f * n + n : m.reach + f * n + n]
        block = [a * b for a, b in zip(past[-2 * n :], window)]
        spectrum = [sum(block[t] * complex(math.cos(2 * math.pi * i * t / (2 * n)), -math.sin(2 * math.pi * i * t / (2 * n))) for t in range(2 * n)) for i in range(bins)]
        level = [math.log10(sum(share(k, i) * abs(spectrum[i]) ** 2 for i in range(bins)) + 1e-9) for k in range(m.bands)]
        now, best = past[-n:], None
        for lag in range(m.shortest, m.longest + 1):
            other = past[len(past) - n - lag : len(past) - lag]
            score = sum(a * b for a, b in zip(other, now)) / math.sqrt(sum(a * a for a in other) * sum(b * b for b in now) + 1e-9)
            if best is None or score > best[1] + 1e-15:
                best = (lag, score)
        v = [*level, *(a - b for a, b in zip(level, before)), best[0] / m.longest, best[1]]
        before = level
        z = [squash(dense("update", v, k) + dense("update_hidden", h, k) + w["update_bias"][k]) for k in range(m.hidden)]
        r = [squash(dense("reset", v, k) + dense("reset_hidden", h, k) + w["reset_bias"][k]) for k in range(m.hidden)]
        rh = [a * b for a, b in zip(r, h)]
        c = [math.tanh(dense("state", v, k) + dense("state_hidden", rh, k) + w["state_bias"][k]) for k in range(m.hidden)]
        h = [z[k] * h[k] + (1 - z[k]) * c[k] for k in range(m.hidden)]
        gains = [squash(dense("gain", h, k) + w["gain_bias"][k]) for k in range(m.bands)]
        activities.append(squash(dense("activity", h, 0) + w["activity_bias"][0]))
        spectrum = [spectrum[i] * sum(gains[k] * share(k, i) for k in range(m.bands)) for i in range(bins)]
        full = spectrum + [spectrum[i].conjugate() for i in range(bins - 2, 0, -1)]
        y = [sum(full[i] * complex(math.cos(2 * math.pi * i * t / (2 * n)), math.sin(2 * math.pi * i * t / (2 * n))) for i in range(2 * n)).real / (2 * n) * window[t] for t in range(2 * n)]
        out += [a + b for a, b in zip(tail, y)]
        tail = y[n:]
    return out, activities


def test_frame_model_equals_plain_loops():
    rng = np.random.default_rng(1)
    x = np.sin(np.arange(16 * 9) * 2 * np.pi / 11) + rng.normal(size=16 * 9) * 0.2
    x[32:64] = 0
    w = random_weights()
    want, activities = plain_frames(x, MODEL, w)
    state = recurrent.FrameState(MODEL, w)
    got = [state.frame_step(f) for f in x.reshape(-1, 16)]
    assert np.allclose(np.concatenate([y for y, _ in got]), want, atol=1e-9) and np.allclose([a for _, a in got], activities, atol=1e-9)
    again = [state.frame_step(f)[1] for f in x.reshape(-1, 16)]
    state.reset()
    assert not np.allclose(again, activities) and np.allclose([state.frame_step(f)[1] for f in x.reshape(-1, 16)], activities)


def test_open_gates_give_the_input_back():
    w = {k: v * 0 for k, v in random_weights().items()}
    w["gain_bias"] = w["gain_bias"] + 50
    x = np.random.default_rng(2).normal(size=101)
    state = recurrent.FrameState(MODEL, w)
    y = np.concatenate([state.push(c) for c in np.array_split(x, 7)] + [state.flush()])
    assert len(y) == 101 and np.allclose(y, x)


def test_chunks_do_not_matter(spark, tmp_path):
    rng = np.random.default_rng(3)
    w = random_weights()
    values = {s: rng.normal(size=n).tolist() for s, n in enumerate((1, 15, 16, 17, 90))}
    want = {}
    for s, v in values.items():
        state = recurrent.FrameState(MODEL, w)
        want[s] = np.concatenate([state.push(v), state.flush()])
        assert len(want[s]) == len(v)
    rows = [(s, i // 7, v[i : i + 7], i + 7 >= len(v), None) for s, v in values.items() for i in range(0, len(v), 7)]
    random.Random(1).shuffle(rows)
    batch = chunks.frame_model(spark.createDataFrame(rows, chunks.CHUNK), MODEL, w).collect()
    for k in range(3):
        spark.createDataFrame(rows[k::3], chunks.CHUNK).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    read = spark.readStream.schema(chunks.CHUNK).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = chunks.frame_model(read, MODEL, w).writeStream.format("memory").queryName("model").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    for found in (batch, spark.table("model").collect()):
        for s, v in values.items():
            parts = sorted((r for r in found if r.stream == s), key=lambda r: r.seq)
            assert np.allclose([x for r in parts for x in r.samples], want[s])
            assert sum(len(r.activity) for r in parts) == -(-len(v) // 16) + 1


def test_weights_are_checked(spark):
    w = random_weights()
    rows = [(k, i, float(x)) for k, v in w.items() for i, x in enumerate(v.ravel())]
    random.Random(2).shuffle(rows)
    table = spark.createDataFrame(rows, "name string, place int, value double")
    found = recurrent.checked_weights(MODEL, chunks.model_weights(table))
    assert all(np.array_equal(found[k], w[k]) for k in w)
    with pytest.raises(ValueError, match="places"):
        chunks.model_weights(table.filter("name <> 'gain' or place <> 3"))
    for bad in ({k: v for k, v in w.items() if k != "gain"}, w | {"gain": w["gain"][1:]}, w | {"gain_bias": w["gain_bias"] * np.nan}):
        with pytest.raises(ValueError):
            recurrent.checked_weights(MODEL, bad)
    state = recurrent.FrameState(MODEL, w)
    for frame in (np.zeros(15), np.full(16, np.nan)):
        with pytest.raises(ValueError):
            state.frame_step(frame)


def plain_subbands(x, c):
    n = 1 if len(x) <= c.frame else math.ceil((len(x) - c.frame) / c.hop) + 1
    x = list(x) + [0.0] * ((n - 1) * c.hop + c.frame - len(x))
    bands = len(subbands.SHARES)
    mean = [[[3.0, 4.5] for _ in range(bands)], [[7.0, 9.0] for _ in range(bands)]]
    width = [[[1.2, 1.2] for _ in range(bands)] for _ in range(2)]
    weight = [[0.6, 0.4], [0.5, 0.5]]
    one, all_, short, long = subbands.LEVELS[c.aggressiveness]
    run = over = 0
    out = []
    for f in range(n):
        pcm = [float(np.round(min(1, max(-1, v)) * 32767)) for v in x[f * c.hop : f * c.hop + c.frame]]
        power = np.abs(np.fft.rfft(pcm)) ** 2 / c.frame
        speech, total = False, 0.0
        shares = [[], []]
        feats = []
        for b in range(bands):
            feat = math.log10(sum(p for i, p in enumerate(power) if subbands.EDGES[b] <= i * c.rate / c.frame < subbands.EDGES[b + 1]) + 1.0)
            feats.append(feat)
            each = [[weight[m][k] * math.exp(-0.5 * ((feat - mean[m][b][k]) / width[m][b][k]) ** 2) / width[m][b][k] + 1e-30 for k in range(2)] for m in range(2)]
            ratio = math.log(sum(each[1]) / sum(each[0]))
            speech = speech or ratio > one
            total += subbands.SHARES[b] * ratio
            for m in range(2):
                shares[m].append([e / sum(each[m]) for e in each[m]])
        speech = speech or total > all_
        m = int(speech)
        for b in range(bands):
            for k in range(2):
                away = feats[b] - mean[m][b][k]
                width[m][b][k] = min(subbands.MOST, max(subbands.LEAST, width[m][b][k] + subbands.STEP["width"] * shares[m][b][k] * (abs(away) - width[m][b][k])))
                mean[m][b][k] += subbands.STEP["speech" if speech else "noise"] * shares[m][b][k] * away
            gap = sum(mean[1][b]) / 2 - sum(mean[0][b]) / 2
            if gap < subbands.APART:
                mean[1][b] = [v + subbands.APART - gap for v in mean[1][b]]
        if speech:
            run += 1
            over = long if run > subbands.LONG else short
        else:
            run = 0
        out.append(speech or over > 0)
        if not speech and over:
            over -= 1
    return out


@pytest.mark.parametrize("aggressiveness", range(4))
def test_subbands_equal_plain_loops(aggressiveness):
    rng = np.random.default_rng(aggressiveness)
    t = np.arange(16_000) / 16_000
    voice = np.sin(2 * np.pi * 180 * t) * 0.2 + np.sin(2 * np.pi * 720 * t) * 0.15 + np.sin(2 * np.pi * 2400 * t) * 0.1
    on = (t % 0.5) > 0.25
    x = rng.normal(size=16_000) * 0.0005 + voice * on
    c = subbands.SubBands(aggressiveness)
    labels = subbands.subband_activity(x, c)
    assert labels.tolist() == plain_subbands(x, c)
    centres = np.minimum(15_999, np.arange(len(labels)) * c.hop + c.frame // 2)
    assert labels[on[centres]].mean() > 0.9
    assert subbands.subband_activity(np.zeros(5), c).shape == (1,) and not subbands.subband_activity(np.zeros(8000), c).any()


def test_subband_settings():
    for bad in ({"aggressiveness": 4}, {"rate": 11_025}, {"frame_ms": 15}, {"hop_ms": 30}):
        with pytest.raises(ValueError):
            subbands.SubBands(**bad)


class Linear:
    loads = 0

    def __init__(self, samples=6, scores=2, off=0):
        self.signature = ({"x": [None, samples]}, {"y": [None, scores]})
        self.scores, self.off = scores, off
        self.seen = []

    def run(self, batch):
        assert batch.dtype == np.float32 and len(batch) <= 3
        self.seen.append(len(batch))
        w = np.arange(1, batch.shape[1] + 1)
        return np.stack([batch @ w + k for k in range(self.scores + self.off)], axis=1)


PROTOCOL = perceived.Protocol({"sig": (1.0, 0.0, 2.0), "bak": (0.5, -1.0)}, samples=6, hop=2, batch=3, input="x", output="y")


def test_scores_are_means_of_calibrated_hops(spark):
    clips = {1: [0.5, -1.0, 0.25, 1.0], 2: [float(i % 5) for i in range(23)], 3: [2.0] * 6}
    want = {}
    for s, x in clips.items():
        y = list(x)
        while len(y) < 6:
            y = y + y
        raw = [[sum((i + 1) * v for i, v in enumerate(y[a : a + 6])) + k for k in range(2)] for a in range(0, len(y) - 5, 2)]
        n = len(raw)
        want[s] = (n, sum(r[0] for r in raw) / n, sum(r[0] ** 2 + 2 for r in raw) / n, sum(r[1] for r in raw) / n, sum(0.5 * r[1] - 1 for r in raw) / n)
    df = spark.createDataFrame(list(clips.items()), "stream long, samples array<double>")
    out = perceived.scored(df, Linear, PROTOCOL)
    assert out.columns == ["stream", "hops", "sig_raw", "sig", "bak_raw", "bak"]
    for r in out.collect():
        assert tuple(r)[1:] == pytest.approx(want[r.stream])


def test_sessions_and_outputs_are_checked():
    for bad in (Linear(samples=7), Linear(scores=3)):
        with pytest.raises(ValueError, match="shapes"):
            perceived.checked_session(bad, PROTOCOL)
    other = Linear()
    other.signature = ({"z": [None, 6]}, {"y": [None, 2]})
    with pytest.raises(ValueError, match="takes"):
        perceived.checked_session(other, PROTOCOL)
    with pytest.raises(ValueError, match="gave"):
        perceived.score_clip(np.ones(6), Linear(off=1), PROTOCOL)
    for clip in ([], [1.0, float("nan")]):
        with pytest.raises(ValueError):
            perceived.hops(np.array(clip), PROTOCOL)
    session = Linear()
    assert perceived.score_clip(np.ones(21), session, PROTOCOL)[0] == 8 and session.seen == [3, 3, 2]


def test_mel_front_end():
    m = perceived.Mel(rate=8000, length=64, hop=32, bands=9)
    w = perceived.mel_weights(m)
    area = (w.sum(axis=1) * 8000 / 64)[4:]
    assert w.shape == (9, 33) and (w >= 0).all() and np.allclose(area, 1, atol=0.2)
    x = np.random.default_rng(5).normal(size=300)
    got = perceived.log_mel(x, m)
    padded = [0.0] * 32 + x.tolist() + [0.0] * 32
    rows = []
    for a in range(0, len(padded) - 63, 32):
        block = [padded[a + i] * (0.5 - 0.5 * math.cos(2 * math.pi * i / 64)) for i in range(64)]
        power = [abs(sum(block[t] * complex(math.cos(2 * math.pi * i * t / 64), -math.sin(2 * math.pi * i * t / 64)) for t in range(64))) ** 2 for i in range(33)]
        rows.append([10 * math.log10(max(1e-10, sum(p * w[k][i] for i, p in enumerate(power)))) for k in range(9)])
    top = max(map(max, rows))
    assert np.allclose(got, [[(max(v - top, -80) + 40) / 40 for v in r] for r in rows], atol=1e-9)
    with pytest.raises(ValueError):
        perceived.Mel(hop=400)


def test_queries_of_models(spark):
    from frameloom.plans import derived, file_queries, kernel_queries

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in derived.table(spark, sf, "documents").collect()}
    c = subbands.SubBands(2, 8_000, 10, 10)
    found = kernel_queries.subband_vad(spark, sf).collect()
    assert len(found) == len(texts)
    for r in found:
        if len(texts[r.stream]) < 3000:
            labels = plain_subbands([((ord(ch) if ord(ch) < 128 else ord(ch)) % 64 - 32) / 32 for ch in texts[r.stream]], c)
            assert (r.frames, r.active) == (len(labels), sum(labels))
    values = {}
    for r in derived.signal(spark, sf).collect():
        values.setdefault(r.stream, {})[r.n] = r.value / 490
    held = {}
    import zlib

    for name in recurrent.SHAPES:
        n = int(np.prod(file_queries._MODEL.shape(name)))
        held[name] = np.array([math.sin(zlib.crc32(f"{name}:{k}".encode())) for k in range(n)])
    for r in file_queries.stream_frame_model(spark, sf).collect():
        x = [values[r.stream][i] for i in range(len(values[r.stream]))]
        n = 8 * -(-len(x) // 8) + 8
        y, activities = plain_frames(x + [0.0] * (n - len(x)), file_queries._MODEL, recurrent.checked_weights(file_queries._MODEL, held))
        assert (r.n, r.frames) == (len(x), n // 8)
        assert (r.total, r.activity) == (pytest.approx(sum(y[8 : 8 + len(x)]), abs=1e-5), pytest.approx(sum(activities), abs=1e-5))


def test_streams_side_by_side_have_the_activity_of_each_alone(monkeypatch):
    rng = np.random.default_rng(5)
    c = subbands.SubBands(2, 8_000, 10, 10)
    xs = [rng.normal(size=n) * rng.choice([0.001, 0.1, 0.5], size=n // 400 + 1).repeat(400)[:n] for n in (0, 1, 79, 80, 81, 2_000, 9_000, 4_000)]
    alone = [subbands.subband_activity(x, c) for x in xs]
    monkeypatch.setattr(subbands.Mixtures, "step", None)
    together = subbands.subband_activity_many(xs, c)
    assert [v.tolist() for v in together] == [v.tolist() for v in alone]
    assert 0 < sum(v.sum() for v in together) < sum(map(len, together))
    assert subbands.subband_activity_many([], c) == []
