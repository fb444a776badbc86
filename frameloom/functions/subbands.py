"""Activity from six sub-bands, each with two Gaussian mixtures that follow the stream: one of noise, one of speech.

A frame's features are the logarithms of its energies in six bands. In each band both mixtures, of two normal distributions, give the feature's likelihood; a frame is speech where one band's
logarithm of their ratio, or the weighted sum of all, is above its threshold. Then the means and widths of the model that was found are drawn to the feature, each component by its
share of the likelihood, and means of speech are kept some distance above those of noise. After speech some frames more are speech (hangover), longer after long speech.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Hz, bounds of the bands
EDGES = (80.0, 250.0, 500.0, 1000.0, 2000.0, 3000.0, 4000.0)
#: weights of the bands' ratios in the sum; the bands in which speech is strongest count most
SHARES = (6.0, 8.0, 10.0, 12.0, 14.0, 16.0)
#: by aggressiveness: threshold of one band, of the sum, frames of hangover after short and after long speech
LEVELS = ((1.5, 24.0, 8, 14), (1.8, 37.0, 8, 14), (2.4, 82.0, 6, 9), (2.8, 90.0, 6, 9))
LONG = 6  # frames in a row of long speech
LEAST, MOST = 0.3, 8.0  # of a component's width
APART = 1.5  # of speech above noise
STEP = {"noise": 0.05, "speech": 0.03, "width": 0.01}


@dataclass(frozen=True)
class SubBands:
    aggressiveness: int = 2
    rate: int = 16_000
    frame_ms: int = 20
    hop_ms: int = 10

    def __post_init__(self):
        if self.aggressiveness not in range(4) or self.rate not in (8_000, 16_000, 32_000, 48_000) or self.frame_ms not in (10, 20, 30) or not 0 < self.hop_ms <= self.frame_ms:
            raise ValueError("aggressiveness is 0 to 3, the rate 8, 16, 32 or 48 kHz, a frame 10, 20 or 30 ms, and the hop not longer")

    @property
    def frame(self) -> int:
        return self.frame_ms * self.rate // 1000

    @property
    def hop(self) -> int:
        return self.hop_ms * self.rate // 1000


class Mixtures:
    """The twelve mixtures, as arrays (model, band, component)."""

    def __init__(self, c: SubBands):
        self.c = c
        bands = len(SHARES)
        self.mean = np.empty((2, bands, 2))
        self.mean[0], self.mean[1] = (3.0, 4.5), (7.0, 9.0)
        self.width = np.ones((2, bands, 2)) * 1.2
        self.weight = np.array([[0.6, 0.4], [0.5, 0.5]])[:, None, :]
        self.run = self.over = 0

    def step(self, feature: np.ndarray) -> bool:
        c = self.c
        one, all_, short, long = LEVELS[c.aggressiveness]
        away = (feature[None, :, None] - self.mean) / self.width
        each = self.weight * np.exp(-0.5 * away**2) / self.width + 1e-30
        total = each.sum(axis=2)
        ratio = np.log(total[1] / total[0])
        speech = bool((ratio > one).any() or (np.array(SHARES) * ratio).sum() > all_)
        k = 1 if speech else 0
        share = each[k] / total[k][:, None]
        pull = STEP["speech" if speech else "noise"] * share
        self.width[k] = np.clip(self.width[k] + STEP["width"] * share * (np.abs(feature[:, None] - self.mean[k]) - self.width[k]), LEAST, MOST)
        self.mean[k] += pull * (feature[:, None] - self.mean[k])
        gap = self.mean[1].mean(axis=1) - self.mean[0].mean(axis=1)
        self.mean[1] += np.maximum(APART - gap, 0)[:, None]
        if speech:
            self.run += 1
            self.over = long if self.run > LONG else short
            return True
        self.run = 0
        if self.over:
            self.over -= 1
            return True
        return False


def band_features(x, c: SubBands) -> np.ndarray:
    """(frames, bands): logarithms of the 16-bit samples' energies; zeros fill the last frame up."""
    x = np.asarray(x, float)
    n = 1 if len(x) <= c.frame else -(-(len(x) - c.frame) // c.hop) + 1
    pcm = np.round(np.clip(np.pad(x, (0, (n - 1) * c.hop + c.frame - len(x))), -1, 1) * 32767)
    frames = np.lib.stride_tricks.sliding_window_view(pcm, c.frame)[:: c.hop][:n]
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2 / c.frame
    hertz = np.arange(power.shape[1]) * c.rate / c.frame
    bands = [(hertz >= a) & (hertz < b) for a, b in zip(EDGES, EDGES[1:])]
    return np.stack([np.log10(power[:, b].sum(axis=1) + 1.0) for b in bands], axis=1)


def subband_activity(x, c: SubBands = SubBands()) -> np.ndarray:
    """A label for each frame of a whole stream."""
    mixtures = Mixtures(c)
    return np.array([mixtures.step(f) for f in band_features(x, c)])


def subband_activity_many(xs: list, c: SubBands = SubBands()) -> list[np.ndarray]:
    """The same for several streams, stepped side by side."""
    features = [band_features(x, c) for x in xs]
    order = sorted(range(len(xs)), key=lambda i: -len(features[i]))
    lengths = np.array([len(features[i]) for i in order])
    one, all_, short, long = LEVELS[c.aggressiveness]
    first, shares = Mixtures(c), np.array(SHARES)
    mean, width = (np.repeat(a[None], len(xs), axis=0) for a in (first.mean, first.width))
    run, over = np.zeros((2, len(xs)), int)
    out = [np.zeros(n, bool) for n in lengths]
    for t in range(lengths[0] if len(xs) else 0):
        n = int(np.count_nonzero(lengths > t))
        mean, width, run, over = mean[:n], width[:n], run[:n], over[:n]
        feature, at = np.stack([features[i][t] for i in order[:n]]), np.arange(n)
        each = first.weight * np.exp(-0.5 * ((feature[:, None, :, None] - mean) / width) ** 2) / width + 1e-30
        total = each.sum(axis=3)
        ratio = np.log(total[:, 1] / total[:, 0])
        speech = (ratio > one).any(axis=1) | ((shares * ratio).sum(axis=1) > all_)
        k = speech.astype(int)
        share = each[at, k] / total[at, k][:, :, None]
        pull = np.where(speech, STEP["speech"], STEP["noise"])[:, None, None] * share
        own, wide = mean[at, k], width[at, k]
        width[at, k] = np.clip(wide + STEP["width"] * share * (np.abs(feature[:, :, None] - own) - wide), LEAST, MOST)
        mean[at, k] = own + pull * (feature[:, :, None] - own)
        gap = mean[:, 1].mean(axis=2) - mean[:, 0].mean(axis=2)
        mean[:, 1] += np.maximum(APART - gap, 0)[:, :, None]
        run = np.where(speech, run + 1, 0)
        for i, label in enumerate((speech | (over > 0)).tolist()):
            out[i][t] = label
        over = np.where(speech, np.where(run > LONG, long, short), np.maximum(over - 1, 0))
    found: list = [None] * len(xs)
    for i, labels in zip(order, out):
        found[i] = labels
    return found
