"""Short-time objective intelligibility of a stream against its clean version (Taal, Hendriks, Heusdens and Jensen, 2011)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .kernels import checked, resample

# Fixed values of the published measure
RATE, LENGTH, TRANSFORM, BANDS, LOWEST, SEGMENT, LEAST_DB, RANGE_DB = 10_000, 256, 512, 15, 150.0, 30, -15.0, 40.0
SMALL = np.finfo(np.float64).eps
MANY = 4096  # segments at a time


@lru_cache(maxsize=1)
def _window() -> np.ndarray:
    return np.hanning(LENGTH + 2)[1:-1]


@lru_cache(maxsize=1)
def third_octaves() -> np.ndarray:
    """(bands, bins): which bins of the transform each third-octave band sums."""
    bins = np.linspace(0, RATE, TRANSFORM + 1)[: TRANSFORM // 2 + 1]
    out = np.zeros((BANDS, len(bins)))
    for k in range(BANDS):
        a, b = (int(np.argmin((bins - LOWEST * 2 ** ((2 * k + d) / 6)) ** 2)) for d in (-1, 1))
        out[k, a:b] = 1
    return out


def _frames(n: int) -> int:
    return len(range(0, n - LENGTH, LENGTH // 2))


def _windowed(x: np.ndarray) -> np.ndarray:
    """(frames, LENGTH)."""
    return np.lib.stride_tricks.sliding_window_view(x, LENGTH)[:: LENGTH // 2][: _frames(len(x))] * _window() if len(x) >= LENGTH else np.zeros((0, LENGTH))


def without_silence(clean: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both streams rebuilt from the windowed frames whose clean energy is within RANGE_DB of the loudest one's."""
    hop = LENGTH // 2
    parts = [_windowed(x) for x in (clean, other)]
    if not len(parts[0]):
        return np.zeros(0), np.zeros(0)
    loud = 20 * np.log10(np.linalg.norm(parts[0], axis=1) + SMALL)
    keep = loud > loud.max() - RANGE_DB
    out = []
    for p in parts:
        p = p[keep]
        x = np.zeros((len(p) + 1, hop))  # a frame is two of these rows
        x[:-1] = p[:, :hop]
        x[1:] += p[:, hop:]
        out.append(x.reshape(-1))
    return out[0], out[1]


def band_levels(x: np.ndarray) -> np.ndarray:
    """(bands, frames)."""
    spectra = np.fft.rfft(_windowed(x), TRANSFORM, axis=1)
    return np.sqrt(third_octaves() @ (np.abs(spectra) ** 2).T)


def stoi(clean, other, rate: int) -> float:
    """The mean correlation of band envelopes over all segments of SEGMENT frames; 1e-5 where the speech is too short for one, as where there is none. Streams of different
    lengths or rates below 1 raise. Segments are taken some thousand at a time, so that memory is linear in the stream; a stream too short for one isn't transformed."""
    if len(clean) != len(other) or rate <= 0:
        raise ValueError("both streams must have one length, and a rate")
    if not len(clean):
        return 1e-5
    clean, other = checked(clean), checked(other)
    clean, other = resample(clean, rate, RATE), resample(other, rate, RATE)
    if _frames(len(clean)) <= SEGMENT:  # rebuilt, a stream has a frame less
        return 1e-5
    clean, other = without_silence(clean, other)
    if _frames(len(clean)) < SEGMENT:
        return 1e-5
    x, y = band_levels(clean), band_levels(other)
    last = x.shape[1] - SEGMENT + 1
    return float(sum(_correlations(x[:, a : a + MANY + SEGMENT - 1], y[:, a : a + MANY + SEGMENT - 1]) for a in range(0, last, MANY)) / (BANDS * last))


def _correlations(x: np.ndarray, y: np.ndarray) -> float:
    """Their sum over the bands and segments of (bands, frames)."""
    x, y = (np.lib.stride_tricks.sliding_window_view(v, SEGMENT, axis=1) for v in (x, y))
    scale = np.linalg.norm(x, axis=2, keepdims=True) / (np.linalg.norm(y, axis=2, keepdims=True) + SMALL)
    y = np.minimum(y * scale, x * (1 + 10 ** (-LEAST_DB / 20)))
    x, y = (v - v.mean(axis=2, keepdims=True) for v in (x, y))
    x, y = (v / (np.linalg.norm(v, axis=2, keepdims=True) + SMALL) for v in (x, y))
    return (x * y).sum()
