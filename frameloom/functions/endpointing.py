"""Segments of speech in live activity: from event to event over a chunk's frames, with a few numbers carried to the next chunk.

A frame is on where its activity is at least ``on``, and loud where it is at least ``off``. A segment opens with the onset-th on-frame in a row, and reaches back to at most
preroll + onset frames, but not to frames of the segment before it. It closes with the hangover-th frame in a row that isn't loud ("silence"), with its maximum-th
frame ("maximum_duration"; silence goes first), or with its stream ("stream_end"). One with too few loud frames is dropped.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np

from .settings import Endpoints


class Segment(NamedTuple):
    start_frame: int
    end_frame: int
    speech_frames: int
    total_frames: int
    reason: str


@dataclass
class Live:
    """Between chunks: frames so far, the first frame that the next segment may have, the open segment's first frame (-1: none), on-frames and silent frames in a
    row, loud frames of the open segment, and, where none is open, which of the last frames were loud."""

    frame: int = 0
    since: int = 0
    begin: int = -1
    onsets: int = 0
    silent: int = 0
    speech: int = 0
    recent: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))


def _runs(hit: np.ndarray, carried: int) -> np.ndarray:
    """How many in a row up to each place; ``carried`` stand before the first."""
    k = np.arange(len(hit))
    missed = np.maximum.accumulate(np.where(hit, -1, k))
    return np.where(missed < 0, k + 1 + carried, k - missed)


def _first(hits: np.ndarray) -> int:
    return int(np.argmax(hits)) if hits.any() else len(hits)


def read(s: Live, activity, c: Endpoints = Endpoints()) -> tuple[Live, list[Segment]]:
    """The state after a chunk of activity, one value for each frame, and the segments that it closes."""
    p = np.asarray(activity, float)
    on, loud = p >= c.on, p >= c.off
    known = np.concatenate([s.recent, loud])  # loud frames from frame ``zero`` on
    zero, first, end = s.frame - len(s.recent), s.frame, s.frame + len(p)
    since, begin, onsets, silent, speech = s.since, s.begin, s.onsets, s.silent, s.speech
    out, at = [], first
    while at < end:
        rest = slice(at - first, None)
        if begin < 0:
            runs = _runs(on[rest], onsets)
            opens = _first(runs >= c.onset)
            if opens == len(runs):
                onsets, at = int(runs[-1]), end
                continue
            at += opens
            begin = max(since, at + 1 - c.preroll - c.onset)
            speech, silent = int(known[begin - zero : at + 1 - zero].sum()), 0
            closes, reason = (at, "maximum_duration") if at + 1 - begin >= c.maximum else (-1, "")
            at += 1
        else:
            runs = _runs(~loud[rest], silent)
            quiet, full = at + _first(runs >= c.hangover), max(at, begin + c.maximum - 1)
            closes, reason = (quiet, "silence") if quiet <= full else (full, "maximum_duration")
            stop = min(closes + 1, end)
            speech += int(loud[at - first : stop - first].sum())
            if closes >= end:
                silent, closes = int(runs[-1]), -1
            at = stop
        if closes >= 0:
            if speech >= c.least_speech:
                out.append(Segment(begin, closes + 1, speech, closes + 1 - begin, reason))
            since, begin, onsets, silent, speech = closes + 1, -1, 0, 0, 0
    keep = max(since, end - c.preroll - c.onset, zero) if begin < 0 else end
    return Live(end, since, begin, onsets if begin < 0 else 0, silent, speech, known[keep - zero :]), out


def ended(s: Live, c: Endpoints = Endpoints()) -> list[Segment]:
    """The segment that the stream's end closes, if one is open."""
    if s.begin < 0 or s.speech < c.least_speech:
        return []
    return [Segment(s.begin, s.frame, s.speech, s.frame - s.begin, "stream_end")]


def segments(activity, c: Endpoints = Endpoints()) -> list[Segment]:
    """Those of a whole stream."""
    s, out = read(Live(), activity, c)
    return out + ended(s, c)
