import numpy as np
import pytest

from frameloom.functions import endpointing, kernels as K
from frameloom.functions.settings import Continuity, Correction, Endpoints, EnergyActivity, Framing, Hysteresis
from frameloom.functions.text import align_words


@pytest.mark.parametrize("n", [1, 127, 128, 129, 384, 511, 512, 513, 2999])
def test_perfect_reconstruction_and_chunks(n):
    x = np.random.default_rng(n).normal(size=n)
    assert np.allclose(K.synthesize(K.analyze(x), n), x)
    s = K.StreamingOverlapAdd()
    y = np.concatenate([s.push(c) for c in np.array_split(x, 7)] + [s.flush()])
    assert len(y) == n and np.allclose(y, x)
    assert len(s.flush()) == 0
    with pytest.raises(RuntimeError):
        s.push([0.0])


def test_hysteresis_and_endpoints():
    labels = K.hysteresis(np.array([0, 0, 9, 10, 7, 3, 2, 1, 0.0]), Hysteresis(8, 4, 2, 2, 1, 0))
    assert labels.tolist() == [False, True, True, True, True, True, True, False, False]
    assert endpointing.segments([0.1, 0.8, 0.9, 0.7, 0.1, 0.1], Endpoints(0.5, 0.5, 2, 2, 2, 1, 100)) == [(0, 6, 3, 6, "silence")]


def test_repeated_windows_and_resampler_delay():
    assert K.repeated_windows([0, 1, 2, 3], 6, 2).tolist() == [[0, 1, 2, 3, 0, 1], [2, 3, 0, 1, 2, 3]]
    assert len(K.repeated_windows(np.zeros(16000) + 1)) == 7
    up, down = K.TripleUp(), K.TripleDown()
    x = np.zeros(600)
    x[200] = 1
    assert np.argmax(np.concatenate([down.push(up.push(c)) for c in np.array_split(x, 11)])) == 242


def test_exponential_integral():
    assert np.allclose(K.exponential_integral(np.array([0.1, 0.5, 1, 2, 5])), [1.82292396, 0.55977359, 0.21938393, 0.04890051, 0.00114830])


@pytest.mark.parametrize("method", K.METHODS)
def test_methods_keep_length_and_bounds(method):
    x = np.random.default_rng(1).normal(size=2000)
    out = K.enhance(x, method)
    assert len(out["samples"]) == 2000 and (out["gain"] <= 1).all() and (out["gain"] >= 0).all()
    if method == "identity":
        assert np.allclose(out["samples"], x)


def test_trackers_reject_and_reset():
    t = K.MinimaTracker()
    t.step(np.ones(5))
    with pytest.raises(ValueError):
        t.step(np.ones(6))
    with pytest.raises(ValueError):
        t.step(-np.ones(5))
    t.reset()
    noise, p = t.run(np.full((30, 17), 5.0))
    assert np.allclose(noise, 5) and (p == 0).all()


def test_activity_continuity_and_mix():
    rng = np.random.default_rng(3)
    x = rng.normal(size=16000) * 1e-4
    x[6000:9000] += np.sin(np.arange(3000) * 0.2)
    found = K.energy_activity(x, EnergyActivity())
    assert found["segments"] and all(0 <= a < b <= 16000 for a, b in found["segments"])
    assert len(K.continuity(x, np.ones(100), Continuity())["samples"]) == 16000
    out = K.correction_mix(x, x, None, Correction())
    assert np.allclose(out["samples"], x)
    assert K.si_sdr(x, 2 * x) > 100
    with pytest.raises(ValueError):
        K.si_sdr(np.zeros(4), np.ones(4))


def test_alignment_goldens():
    assert align_words("a b c d e f".split(), "a x c y d e".split()) == (1, 1, 1)
    assert align_words("three quiet words".split(), []) == (0, 3, 0)
    assert sum(align_words("six green apples fell".split(), "the boats came home late".split())) / 5 == 1.0


def test_settings_reject():
    with pytest.raises(ValueError):
        Hysteresis(1, 2)
    with pytest.raises(ValueError):
        Framing(4, 5)


def test_texts_pass_to_kernels_as_code_points(spark):
    from frameloom.operators import signals
    from frameloom.plans import kernel_queries

    df = spark.createDataFrame([(1, "aé\U0001f600z"), (2, ""), (3, "b" * 9)], "stream long, text string")
    got = signals.per_stream(df, lambda x: {"codes": x.astype("int64")}, {"codes": "array<long>"}, ["text"])
    assert {r.stream: r.codes for r in got.collect()} == {1: [97, 233, 0x1F600, 122], 2: [], 3: [98] * 9}
    for query in (kernel_queries.intelligibility, kernel_queries.subband_vad):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "array<double>" not in plan and "split(" not in plan and "transform(" not in plan
