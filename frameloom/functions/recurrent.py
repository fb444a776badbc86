"""A recurrent frame model for suppressing noise: band energies and pitch in, band gains and an activity out, frame by frame.

Of each frame the model sees, in a window of it and the frame before: the logarithms of the energies of ``bands`` triangular bands, their changes from the frame before, the pitch
period and its normalized correlation over the last ``reach`` samples. A gated recurrent unit carries them on; two dense layers give the bands' gains and the activity. Gains are laid over the
window's spectrum, and windows are added up again, so that the output is one frame behind.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

EPS = 1e-9
#: names of the weights, with their shapes in inputs (i), hidden units (h) and bands (b)
SHAPES = {"update": "ih", "update_hidden": "hh", "update_bias": "h", "reset": "ih", "reset_hidden": "hh", "reset_bias": "h", "state": "ih", "state_hidden": "hh", "state_bias": "h", "gain": "hb", "gain_bias": "b", "activity": "h1", "activity_bias": "1"}


@dataclass(frozen=True)
class FrameModel:
    frame: int = 480
    bands: int = 18
    hidden: int = 24
    shortest: int = 60  # pitch periods, in samples
    longest: int = 768

    def __post_init__(self):
        if min(self.frame, self.hidden, self.shortest) < 1 or self.bands < 2 or self.longest <= self.shortest:
            raise ValueError("a frame model's sizes must be positive, and its longest period above the shortest")

    @property
    def inputs(self) -> int:
        return 2 * self.bands + 2

    @property
    def reach(self) -> int:
        """Samples before the frame's end that the pitch is sought in."""
        return self.frame + self.longest

    def shape(self, name: str) -> tuple[int, ...]:
        sizes = {"i": self.inputs, "h": self.hidden, "b": self.bands, "1": 1}
        return tuple(sizes[k] for k in SHAPES[name])


def checked_weights(m: FrameModel, weights: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Each weight at its shape and finite; missing and further ones raise."""
    if weights.keys() != SHAPES.keys():
        raise ValueError(f"weights must be {sorted(SHAPES)}")
    out = {}
    for name, values in weights.items():
        w = np.asarray(values, float)
        if w.size != np.prod(m.shape(name)) or not np.isfinite(w).all():
            raise ValueError(f"{name} must hold {m.shape(name)} finite numbers")
        out[name] = w.reshape(m.shape(name))
    return out


def band_weights(m: FrameModel) -> np.ndarray:
    """(bands, bins) of triangles whose peaks grow further apart with the square of their number; at each bin they sum to one."""
    bins = m.frame + 1
    peaks = (bins - 1) * (np.arange(m.bands) / (m.bands - 1)) ** 2
    at = np.arange(bins)
    return np.array([np.interp(at, peaks, np.eye(m.bands)[k]) for k in range(m.bands)])


def pitch(m: FrameModel, past: np.ndarray) -> tuple[int, float]:
    """(period, correlation) of the last frame of ``past``: the lag of largest normalized correlation with what lies so many samples before it, the shortest of equals."""
    now = past[-m.frame :]
    lags = np.arange(m.shortest, m.longest + 1)
    before = np.lib.stride_tricks.sliding_window_view(past, m.frame)[len(past) - m.frame - lags]
    score = before @ now / np.sqrt((before**2).sum(axis=1) * (now @ now) + EPS)
    k = int(np.argmax(score))
    return int(lags[k]), float(score[k])


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class FrameState:
    """The model along a stream: ``frame_step`` takes one frame and gives one back; push and flush take chunks of any size. What it carries are plain arrays."""

    carried = ("held", "past", "before", "unit", "tail", "activities"), ("taken", "given")

    def __init__(self, m: FrameModel, weights: dict[str, np.ndarray]):
        self.m, self.w = m, checked_weights(m, weights)
        self.weights_of_bands = band_weights(m)
        self.window = np.sin(np.pi * (np.arange(2 * m.frame) + 0.5) / (2 * m.frame))
        self.reset()

    def reset(self) -> None:
        m = self.m
        self.held, self.past, self.before, self.unit, self.tail, self.activities = np.zeros(0), np.zeros(m.reach), np.zeros(m.bands), np.zeros(m.hidden), np.zeros(m.frame), np.zeros(0)
        self.taken = self.given = 0

    def frame_step(self, frame: np.ndarray) -> tuple[np.ndarray, float]:
        m, w = self.m, self.w
        frame = np.asarray(frame, float)
        if frame.shape != (m.frame,) or not np.isfinite(frame).all():
            raise ValueError(f"a frame has {m.frame} finite samples")
        self.past = np.concatenate([self.past[m.frame :], frame])
        spectrum = np.fft.rfft(self.past[-2 * m.frame :] * self.window)
        level = np.log10(self.weights_of_bands @ np.abs(spectrum) ** 2 + EPS)
        period, correlation = pitch(m, self.past)
        x = np.concatenate([level, level - self.before, [period / m.longest, correlation]])
        self.before = level
        h = self.unit
        z = _squash(x @ w["update"] + h @ w["update_hidden"] + w["update_bias"])
        r = _squash(x @ w["reset"] + h @ w["reset_hidden"] + w["reset_bias"])
        c = np.tanh(x @ w["state"] + (r * h) @ w["state_hidden"] + w["state_bias"])
        self.unit = z * h + (1 - z) * c
        gains = _squash(self.unit @ w["gain"] + w["gain_bias"])
        activity = float(_squash(self.unit @ w["activity"] + w["activity_bias"])[0])
        y = np.fft.irfft(spectrum * (gains @ self.weights_of_bands), 2 * m.frame) * self.window
        out, self.tail = self.tail + y[: m.frame], y[m.frame :]
        return out, activity

    def push(self, chunk) -> np.ndarray:
        """Whole frames' output, the first (silent) frame left out, so that samples keep their places."""
        self.held = np.concatenate([self.held, np.asarray(chunk, float)])
        self.taken += len(chunk)
        out, found = [np.zeros(0)], []
        while len(self.held) >= self.m.frame:
            y, activity = self.frame_step(self.held[: self.m.frame])
            self.held = self.held[self.m.frame :]
            found.append(activity)
            out.append(y)
        first = self.given == 0 and len(out) > 1
        self.given += len(out) - 1
        self.activities = np.array(found)
        return np.concatenate([out[0], *out[2 if first else 1 :]])

    def flush(self) -> np.ndarray:
        """What is left, zeros filling the last frame up and one more after it; as many samples as were taken in all."""
        produced = max(0, self.given - 1) * self.m.frame
        left = self.taken - produced
        y = self.push(np.zeros(-len(self.held) % self.m.frame + self.m.frame)) if left else np.zeros(0)
        return y[:left]
