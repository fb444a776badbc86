"""Settings of the signal operators: frozen, validated, passed explicitly. ``FROZEN`` holds the presets of the fixed protocol."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil


def _within(name: str, value: float, least: float, most: float, open_: bool = False) -> None:
    if not (least < value < most if open_ else least <= value <= most):
        raise ValueError(f"{name} must lie within {least} and {most}")


@dataclass(frozen=True)
class Framing:
    length: int = 512
    hop: int = 128

    def __post_init__(self):
        if not 0 < self.hop <= self.length:
            raise ValueError("hop must be positive and at most the frame length")


@dataclass(frozen=True)
class Minima:
    """Noise tracking by minima of the smoothed spectrum."""

    noise_memory: float = 0.95
    presence_memory: float = 0.2
    smoothing: float = 0.8
    window: int = 125
    ratio: float = 5.0

    def __post_init__(self):
        for name in ("noise_memory", "presence_memory", "smoothing"):
            _within(name, getattr(self, name), 0, 1)
        if self.window < 1 or self.ratio <= 0:
            raise ValueError("window and ratio must be positive")


@dataclass(frozen=True)
class ImprovedMinima:
    smoothing: float = 0.9
    noise_memory: float = 0.85
    subwindow: int = 15
    history: int = 8
    bias_minimum: float = 1.66
    bias: float = 1.4685
    gamma0: float = 4.6
    zeta0: float = 1.67
    gamma1: float = 3.0
    prior_memory: float = 0.95
    least_prior_db: float = -18.0

    def __post_init__(self):
        for name in ("smoothing", "noise_memory", "prior_memory"):
            _within(name, getattr(self, name), 0, 1)
        if self.subwindow < 1 or self.history < 1 or self.gamma1 <= 1:
            raise ValueError("subwindow and history must be positive, gamma1 above 1")


@dataclass(frozen=True)
class Gain:
    """Decision-directed gains."""

    memory: float = 0.96
    floor: float = 0.30
    fall: float = 0.7
    rise: float = 0.4
    frequency_smoothing: float = 0.0
    startup_frames: int = 0

    def __post_init__(self):
        for name in ("memory", "fall", "rise"):
            _within(name, getattr(self, name), 0, 1)
        _within("floor", self.floor, 0, 1)


@dataclass(frozen=True)
class Hysteresis:
    on: float
    off: float
    onset: int = 2
    hangover: int = 20
    preroll: int = 10
    minimum: int = 10

    def __post_init__(self):
        if self.off > self.on:
            raise ValueError("off must not exceed on")
        if self.onset < 1 or min(self.hangover, self.preroll, self.minimum) < 0:
            raise ValueError("frame counts must not be negative, onset positive")


@dataclass(frozen=True)
class EnergyActivity:
    frame: Framing = Framing(320, 160)
    window: int = 200
    quantile: float = 0.2
    rising: float = 0.98
    falling: float = 0.8
    start_db: float = -55.0
    least_db: float = -120.0
    midpoint_db: float = 6.0
    scale_db: float = 2.0
    machine: Hysteresis = Hysteresis(12.0, 9.0)


@dataclass(frozen=True)
class StatisticalActivity:
    frame: Framing = Framing(320, 160)
    fft: int = 512
    rate: int = 16000
    band: tuple[float, float] = (80.0, 4000.0)
    memory: float = 0.98
    scale: float = 0.1
    machine: Hysteresis = Hysteresis(20.0, 10.0)


def milliseconds_to_frames(milliseconds: float, frame: float = 10.0) -> int:
    """Frames that hold so many milliseconds, the last begun one counted; they must be positive."""
    if milliseconds <= 0:
        raise ValueError("milliseconds must be positive")
    return ceil(milliseconds / frame)


@dataclass(frozen=True)
class Endpoints:
    on: float = 0.5
    off: float = 0.35
    onset: int = 2
    hangover: int = 70
    preroll: int = 20
    least_speech: int = 10
    maximum: int = 1000

    def __post_init__(self):
        if self.off > self.on:
            raise ValueError("off must not exceed on")
        if min(self.onset, self.hangover, self.maximum) < 1 or self.preroll < 0:
            raise ValueError("onset, hangover and maximum must be positive")

    @classmethod
    def from_milliseconds(cls, hangover: float = 700, preroll: float = 200, least_speech: float = 100, maximum: float = 10_000, onset: float = 20, **more) -> "Endpoints":
        frames = milliseconds_to_frames
        return cls(hangover=frames(hangover), preroll=frames(preroll), least_speech=frames(least_speech), maximum=frames(maximum), onset=frames(onset), **more)


@dataclass(frozen=True)
class Continuity:
    block: int = 160
    voiced: float = 0.6
    release_db: float = 1.5
    drop_db: float = 4.0
    most_boost_db: float = 3.0
    least_rms: float = 1e-5

    def __post_init__(self):
        if self.block < 1 or min(self.release_db, self.drop_db, self.most_boost_db) < 0:
            raise ValueError("block must be positive, decibels not negative")


@dataclass(frozen=True)
class Correction:
    block: int = 160
    threshold_db: float = -9.0
    scale_db: float = 1.5
    memory: float = 0.8
    protection: float = 0.30
    attack: float = 0.30
    release: float = 0.85
    start: float = 0.5


@dataclass(frozen=True)
class Placement:
    """Speech in a labelled mixture; times in seconds."""

    rate: int = 16_000
    seconds: float = 10.0
    fewest: int = 1
    most: int = 4
    shortest: float = 0.5
    longest: float = 2.0
    least_gap: float = 0.3
    most_gap: float = 2.0
    peak: float = 0.98

    def __post_init__(self):
        if self.rate <= 0 or self.seconds <= 0 or self.peak <= 0:
            raise ValueError("rate, length and peak must be positive")
        if not 1 <= self.fewest <= self.most or not 0 < self.shortest <= self.longest or not 0 <= self.least_gap <= self.most_gap:
            raise ValueError("a range is the wrong way round")


FROZEN = {
    "statistical_activity": StatisticalActivity(memory=0.98, machine=Hysteresis(0.80, 0.79)),
    "energy_activity": EnergyActivity(machine=Hysteresis(12.0, 6.0)),
    "wiener": Gain(memory=0.92, floor=0.20),
    "om_lsa": Gain(memory=0.92, floor=0.10),
}
