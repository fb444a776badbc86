"""Perceived quality by a model that is given: hops of whole clips in batches, checked outputs, calibration of each hop, means of each clip; and the mel front end that some models take.

``load`` makes a session once for each task. A session says its inputs and outputs (``signature``) and runs a batch: an array of (hops, samples) in 32-bit floats to one of (hops, scores).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Protocol:
    """Samples and hop of a window, hops in a batch, the names of a session's input and output, and each score's calibration polynomial, highest power first."""

    calibration: dict[str, tuple[float, ...]]
    samples: int = 144_160
    hop: int = 16_000
    batch: int = 8
    input: str = "input_1"
    output: str = "Identity:0"

    def __post_init__(self):
        if min(self.samples, self.hop, self.batch) < 1 or not self.calibration or not all(self.calibration.values()):
            raise ValueError("a protocol's sizes must be positive, and each score needs its calibration")


def checked_session(session, p: Protocol):
    """The session, if it has the protocol's input and output and no others, of its sizes; None stands for any size."""
    inputs, outputs = session.signature
    if inputs.keys() != {p.input} or p.output not in outputs:
        raise ValueError(f"the session takes {sorted(inputs)} and gives {sorted(outputs)}")
    for have, want in ((inputs[p.input], p.samples), (outputs[p.output], len(p.calibration))):
        if len(have) != 2 or have[1] not in (None, want) or have[0] not in (None, p.batch):
            raise ValueError(f"the session's shapes are {inputs} and {outputs}")
    return session


def hops(x: np.ndarray, p: Protocol) -> np.ndarray:
    """(hops, samples), without copies where the clip is long enough: a shorter one is doubled until it fills a window. Only whole windows count."""
    x = np.asarray(x, np.float32)
    if not len(x) or not np.isfinite(x).all():
        raise ValueError("a clip must have samples, all of them finite")
    if len(x) < p.samples:
        x = np.tile(x, 1 << int(np.ceil(np.log2(p.samples / len(x)))))
    return np.lib.stride_tricks.sliding_window_view(x, p.samples)[:: p.hop]


def score_clip(x: np.ndarray, session, p: Protocol) -> tuple[int, list[float], list[float]]:
    """(hops, raw means, means of calibrated hops), the scores in the protocol's order."""
    windows = hops(x, p)
    raw = []
    for a in range(0, len(windows), p.batch):
        batch = np.ascontiguousarray(windows[a : a + p.batch])
        out = np.asarray(session.run(batch), float)
        if out.shape != (len(batch), len(p.calibration)) or not np.isfinite(out).all():
            raise ValueError(f"the model gave {out.shape} for {len(batch)} hops, or numbers that aren't finite")
        raw.append(out)
    raw = np.concatenate(raw)
    calibrated = [float(np.polyval(c, raw[:, k]).mean()) for k, c in enumerate(p.calibration.values())]
    return len(raw), raw.mean(axis=0).tolist(), calibrated


def scored(df: DataFrame, load: Callable[[], object], p: Protocol) -> DataFrame:
    """``df(stream, samples)``, at the model's rate, as (stream, hops, <score>_raw, <score>, ...). Clips are independent, so nothing moves; one is held whole."""
    names = [n for score in p.calibration for n in (f"{score}_raw", score)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session = checked_session(load(), p)
        for batch in batches:
            ends, values = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy(zero_copy_only=False)
            found = [score_clip(values[a:b], session, p) for a, b in zip(ends[:-1], ends[1:])]
            columns = [pa.array([f[1 + side][k] for f in found], pa.float64()) for k in range(len(p.calibration)) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.int64()), *columns], ["stream", "hops", *names])

    shape = f"stream {df.schema['stream'].dataType.simpleString()}, hops long, " + ", ".join(f"{n} double" for n in names)
    return df.select("stream", "samples").mapInArrow(run, shape)


@dataclass(frozen=True)
class Mel:
    rate: int = 16_000
    length: int = 320
    hop: int = 160
    bands: int = 120

    def __post_init__(self):
        if not 0 < self.hop <= self.length or self.bands < 1 or self.rate < 1:
            raise ValueError("a mel front end's sizes must be positive, and its hop not beyond its length")


def mel_weights(m: Mel) -> np.ndarray:
    """(bands, bins): triangles of equal area between points that lie evenly on the mel scale (linear to 1 kHz, logarithmic from there) from 0 to half the rate."""
    step, corner = 200 / 3, 15.0
    to_mel = lambda f: f / step if f < 1000 else corner + np.log(f / 1000) * 27 / np.log(6.4)
    mels = np.linspace(0, to_mel(m.rate / 2), m.bands + 2)
    hertz = np.where(mels < corner, mels * step, 1000 * np.exp((mels - corner) * np.log(6.4) / 27))
    bins = np.arange(m.length // 2 + 1) * m.rate / m.length
    rise = (bins - hertz[:-2, None]) / np.diff(hertz)[:-1, None]
    fall = (hertz[2:, None] - bins) / np.diff(hertz)[1:, None]
    return np.maximum(0, np.minimum(rise, fall)) * (2 / (hertz[2:] - hertz[:-2]))[:, None]


def log_mel(x, m: Mel = Mel()) -> np.ndarray:
    """(frames, bands): decibels below the loudest, at most 80, brought to -1 to 1; frames stand around their centres, zeros beyond both ends."""
    x = np.pad(np.asarray(x, float), m.length // 2)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(m.length) / m.length)
    frames = np.lib.stride_tricks.sliding_window_view(x, m.length)[:: m.hop] * window
    power = (np.abs(np.fft.rfft(frames, axis=1)) ** 2) @ mel_weights(m).T
    db = 10 * np.log10(np.maximum(power, 1e-10))
    return (np.maximum(db - db.max(), -80) + 40) / 40
