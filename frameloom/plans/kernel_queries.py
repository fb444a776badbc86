"""Queries of the stream kernels. Most follow recurrences that SQL says step by step, from the same settings, over streams long enough for the
trackers' windows to roll over; the others are held against plain versions by tests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions import endpointing, kernels, perception, subbands
from ..functions.settings import Continuity, Correction, Endpoints, EnergyActivity, Framing, Gain, Hysteresis, ImprovedMinima, Minima, Placement, StatisticalActivity
from ..operators import perceived, signals
from .derived import PAIRS, SIGNAL, pairs, signal, table, vectors
from .queries import _FRAMES, _LIST, SHORT, SMALL, _weighted, query


def long_streams(spark, sf_dir) -> DataFrame:
    """(stream, samples): the events of each type and of fifty users at a time, in order, as one stream; there are more streams, not longer ones, where there are more users."""
    stream = F.concat("event_type", F.lit("_"), F.floor(F.col("user_id") / 50))
    df = table(spark, sf_dir, "events").groupBy(stream.alias("stream")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("a"))
    return df.select("stream", F.transform("a", lambda x: x["value"]).alias("samples"))


def _points(df: DataFrame, *columns: str) -> DataFrame:
    """Arrays of one length as rows (stream, n, value of each)."""
    zipped = df.select("stream", F.posexplode(F.arrays_zip(*columns)).alias("n", "_z"))
    return zipped.select("stream", F.col("n").cast("long").alias("n"), *(F.col("_z")[c].alias(c) for c in columns))


def _cells(df: DataFrame, *columns: str) -> DataFrame:
    """Matrices of one shape as rows (stream, frame, bin, value of each)."""
    at = _points(df, *columns).withColumnRenamed("n", "frame")
    cells = at.select("stream", "frame", F.posexplode(F.arrays_zip(*columns)).alias("bin", "_z"))
    return cells.select("stream", "frame", F.col("bin").cast("long").alias("bin"), *(F.col("_z")[c].alias(c) for c in columns))


_N, _HOP = SHORT.length, SHORT.hop
_BINS = _N // 2 + 1
_EPS, _MOST = f"{kernels.EPS!r}::DOUBLE", f"{kernels.MOST_SNR!r}::DOUBLE"


def _spectra(source: str) -> str:
    """spec(stream, frame, bin, re, im, p) of source(stream, n, value), and windowed(stream, frame, o, w)."""
    return f"""sizes AS (SELECT stream, count(*) AS size FROM {source} GROUP BY stream),
windowed AS MATERIALIZED (SELECT stream, frame, o, sqrt(0.5 - 0.5 * cos(2 * pi() * o / {_N})) AS w FROM (SELECT stream, unnest(range(0, (greatest(ceil((size - {_HOP}) / {_HOP}.0), 0) + 1)::BIGINT)) AS frame FROM sizes), range(0, {_N}) t(o)),
framed AS (SELECT f.stream, frame, o, w * coalesce(value, 0) AS y FROM windowed f LEFT JOIN {source} s ON s.stream = f.stream AND s.n = frame * {_HOP} + o - {_N - _HOP}),
parts AS (SELECT stream, frame, bin, sum(y * cos(2 * pi() * bin * o / {_N})) AS re, -sum(y * sin(2 * pi() * bin * o / {_N})) AS im FROM framed, range(0, {_BINS}) t(bin) GROUP BY ALL),
spec AS MATERIALIZED (SELECT *, re * re + im * im AS p FROM parts)"""


_LONG = "long_ AS MATERIALIZED (SELECT event_type || '_' || (user_id // 50) AS stream, row_number() OVER (PARTITION BY event_type, user_id // 50 ORDER BY ts, event_id) - 1 AS n, value FROM events)"
_VECTOR_POINTS = "points AS MATERIALIZED (SELECT vec_id AS stream, generate_subscripts(embedding, 1) - 1 AS n, unnest(embedding)::DOUBLE AS value FROM embeddings)"


@query(f"WITH {_VECTOR_POINTS}, {_spectra('points')} SELECT stream, frame, bin, round(p, 6) AS power FROM spec")
def stft_power(spark, sf_dir):
    return _cells(signals.spectrum_power(vectors(spark, sf_dir), SHORT), "power").withColumn("power", F.round("power", 6))


@query(f"WITH {PAIRS} SELECT stream, round({_LIST('reference')}, 6) AS weighted FROM pairs")
def wola_roundtrip(spark, sf_dir):
    df = signals.per_stream(vectors(spark, sf_dir), lambda x: {"y": kernels.synthesize(kernels.analyze(x, SHORT), len(x), SHORT)}, {"y": "array<double>"})
    return df.select("stream", _weighted("y").alias("weighted"))


@query(f"WITH {SIGNAL} SELECT stream, n, round(value, 6) AS value FROM signal")
def overlap_add_sql(spark, sf_dir):
    df = signals.with_windowed_sum(signal(spark, sf_dir), SMALL)
    return df.select("stream", "n", F.round("value", 6).alias("value"))


_M = Minima()
#: tracked(stream, frame, bin, q, noise) of spec(stream, frame, bin, p)
_TRACK = f"""near AS MATERIALIZED (SELECT a.stream, a.frame, a.bin, a.p, 0.25 * lo.p + 0.5 * a.p + 0.25 * hi.p AS now FROM spec a JOIN spec lo ON lo.stream = a.stream AND lo.frame = a.frame AND lo.bin = greatest(a.bin - 1, 0) JOIN spec hi ON hi.stream = a.stream AND hi.frame = a.frame AND hi.bin = least(a.bin + 1, {_BINS - 1})),
calm(stream, frame, bin, s) AS (SELECT stream, frame, bin, now FROM near WHERE frame = 0 UNION ALL SELECT x.stream, x.frame, x.bin, {_M.smoothing}::DOUBLE * c.s + (1 - {_M.smoothing}::DOUBLE) * now FROM calm c JOIN near x ON x.stream = c.stream AND x.bin = c.bin AND x.frame = c.frame + 1),
least_ AS (SELECT *, min(s) OVER (PARTITION BY stream, bin ORDER BY frame ROWS {_M.window - 1} PRECEDING) AS least FROM calm),
present AS MATERIALIZED (SELECT l.stream, l.frame, l.bin, x.p, (s / greatest(least, {_EPS}) > {_M.ratio})::INT::DOUBLE AS here FROM least_ l JOIN spec x ON x.stream = l.stream AND x.frame = l.frame AND x.bin = l.bin),
tracked(stream, frame, bin, q, noise) AS (
  SELECT stream, frame, bin, (1 - {_M.presence_memory}::DOUBLE) * here, p FROM present WHERE frame = 0
  UNION ALL SELECT stream, frame, bin, q, a * noise + (1 - a) * p FROM (SELECT x.stream, x.frame, x.bin, x.p, t.noise, {_M.presence_memory}::DOUBLE * t.q + (1 - {_M.presence_memory}::DOUBLE) * here AS q, {_M.noise_memory}::DOUBLE + (1 - {_M.noise_memory}::DOUBLE) * ({_M.presence_memory}::DOUBLE * t.q + (1 - {_M.presence_memory}::DOUBLE) * here) AS a
    FROM tracked t JOIN present x ON x.stream = t.stream AND x.bin = t.bin AND x.frame = t.frame + 1))"""
_NOISE = f"{_LONG}, {_spectra('long_')}, {_TRACK}"


def _tracked(spark, sf_dir, tracker) -> DataFrame:
    def track(xs):
        return [{"noise": n, "presence": p} for n, p in kernels.tracked_many([np.abs(kernels.analyze(x, SHORT)) ** 2 for x in xs], tracker)]

    return signals.per_batch(long_streams(spark, sf_dir), track, {"noise": "array<array<double>>", "presence": "array<array<double>>"})


@query(f"WITH RECURSIVE {_NOISE} SELECT stream, frame, bin, round(noise, 3) AS noise, round(q, 6) AS presence FROM tracked")
def noise_psd(spark, sf_dir):
    df = _tracked(spark, sf_dir, kernels.MinimaTracker)
    return _cells(df, "noise", "presence").select("stream", "frame", "bin", F.round("noise", 3).alias("noise"), F.round("presence", 6).alias("presence"))


@query()
def improved_noise_psd(spark, sf_dir):
    return _cells(_tracked(spark, sf_dir, lambda: kernels.ImprovedMinimaTracker(ImprovedMinima())), "noise", "presence")


_G = Gain()
_SNR = f"snr AS MATERIALIZED (SELECT t.stream, t.frame, t.bin, t.q, t.noise, x.p, least(greatest(x.p / greatest(noise, {_EPS}), 0), {_MOST}) AS gamma FROM tracked t JOIN spec x ON x.stream = t.stream AND x.frame = t.frame AND x.bin = t.bin)"
_XI = f"least(greatest({_G.memory}::DOUBLE * r.gain * r.gain * r.gamma + (1 - {_G.memory}::DOUBLE) * greatest(x.gamma - 1, 0), 0), {_MOST})"
_SMALL_E = "(-0.5772156649015329::DOUBLE - ln(least(v, 1.0)) - list_sum(list_transform(range(1, 25), lambda k: pow(-least(v, 1.0), k) / (k * factorial(k::INT)::DOUBLE))))"
_BIG_E = "(exp(-greatest(v, 1.0)) / (greatest(v, 1.0) + list_reduce(list_concat([0.0::DOUBLE], list_transform(range(80, 0, -1), lambda k: k::DOUBLE)), lambda f, k: k / (1 + k / (greatest(v, 1.0) + f)))))"


def _lsa(source: str) -> str:
    """(stream, frame, bin, gamma, gain) of source(stream, frame, bin, gamma, q, xi)."""
    clip = lambda x, a, b: f"least(greatest({x}, {a}), {b})"
    one = f"SELECT *, {clip('1 - q', 0.05, 0.95)} AS absent, gamma * (xi / (1 + xi)) AS v0 FROM ({source})"
    two = f"SELECT *, 1 / (1 + exp({clip('ln(absent) - ln(1 - absent) + ln(1 + xi) - v0', -60, 60)})) AS chance, greatest(v0, {_EPS}) AS v FROM ({one})"
    lg = clip(f"ln(greatest(xi, {_EPS})) - ln(1 + xi) + 0.5 * CASE WHEN v <= 1 THEN {_SMALL_E} ELSE {_BIG_E} END", -60, 0)
    three = f"SELECT *, {lg} AS log_gain FROM ({two})"
    return f"SELECT stream, frame, bin, gamma, {clip('exp(' + clip(f'chance * log_gain + (1 - chance) * ln({_G.floor}::DOUBLE)', -60, 0) + ')', f'{_G.floor}::DOUBLE', 1.0)} AS gain FROM ({three})"


def _smoothed(raw: str, before: str) -> str:
    """The gain that follows ``raw`` from ``before``, without smoothing over frequencies or a start-up ramp, which the default settings leave out."""
    a = f"CASE WHEN {raw} < {before} THEN {_G.fall}::DOUBLE ELSE {_G.rise}::DOUBLE END"
    return f"least(greatest(({a}) * {before} + (1 - ({a})) * {raw}, {_G.floor}), 1.0)"


_FLOOR = f"{_G.floor}::DOUBLE"
_WIENER = lambda xi: f"least(greatest({xi} / (1 + {xi}), {_FLOOR}), 1.0)"
_GAINS = {
    "identity": "gains AS (SELECT stream, frame, bin, 1.0::DOUBLE AS gain FROM tracked)",
    "subtraction": f"{_SNR}, gains AS (SELECT stream, frame, bin, least(greatest(sqrt(greatest(p - noise, {_FLOOR} * {_FLOOR} * p) / (p + {_EPS})), {_FLOOR}), 1.0) AS gain FROM snr)",
    "instantaneous": f"{_SNR}, gains AS (SELECT stream, frame, bin, least(greatest(greatest(gamma - 1, 0) / (1 + greatest(gamma - 1, 0)), {_FLOOR}), 1.0) AS gain FROM snr)",
    "wiener": f"""{_SNR}, gains(stream, frame, bin, gamma, gain) AS (
  SELECT stream, frame, bin, gamma, {_smoothed('raw', '1.0')} FROM (SELECT *, {_WIENER('greatest(gamma - 1, 0)')} AS raw FROM snr WHERE frame = 0)
  UNION ALL SELECT stream, frame, bin, gamma, {_smoothed('raw', 'old')} FROM (SELECT *, {_WIENER('xi')} AS raw FROM (SELECT x.stream, x.frame, x.bin, x.gamma, r.gain AS old, {_XI} AS xi FROM gains r JOIN snr x ON x.stream = r.stream AND x.bin = r.bin AND x.frame = r.frame + 1)))""",
    "om_lsa": f"""{_SNR}, gains(stream, frame, bin, gamma, gain) AS (
  {_lsa('SELECT stream, frame, bin, gamma, q, greatest(gamma - 1, 0) AS xi FROM snr WHERE frame = 0')}
  UNION ALL {_lsa(f'SELECT x.stream, x.frame, x.bin, x.gamma, x.q, {_XI} AS xi FROM gains r JOIN snr x ON x.stream = r.stream AND x.bin = r.bin AND x.frame = r.frame + 1')})""",
}
_SYNTHESIS = f"""back AS (SELECT f.stream, f.frame, f.o, f.w, sum((CASE WHEN x.bin IN (0, {_BINS - 1}) THEN 1 ELSE 2 END) * g.gain * (x.re * cos(2 * pi() * x.bin * f.o / {_N}) - x.im * sin(2 * pi() * x.bin * f.o / {_N}))) / {_N} AS y
  FROM windowed f JOIN spec x ON x.stream = f.stream AND x.frame = f.frame JOIN gains g ON g.stream = x.stream AND g.frame = x.frame AND g.bin = x.bin GROUP BY ALL),
added AS (SELECT b.stream, frame * {_HOP} + o - {_N - _HOP} AS n, sum(y * w) / sum(w * w) AS value FROM back b GROUP BY ALL)
SELECT a.stream, n, round(value, 3) AS value FROM added a JOIN sizes z ON z.stream = a.stream WHERE n >= 0 AND n < size"""


def _enhanced(method: str):
    def run(spark, sf_dir):
        df = signals.enhance(long_streams(spark, sf_dir), method, SHORT, activity=StatisticalActivity(frame=SMALL, fft=16, band=(0.0, 8000.0)))
        return _points(df, "samples").select("stream", "n", F.round("samples", 3).alias("value"))

    run.__name__ = f"enhance_{method}"
    return query(f"WITH RECURSIVE {_NOISE}, {_GAINS[method]}, {_SYNTHESIS}" if method in _GAINS else None)(run)


for _method in kernels.METHODS:
    _enhanced(_method)


def _arrays(spark, sf_dir) -> DataFrame:
    df = signal(spark, sf_dir).groupBy("stream").agg(F.array_sort(F.collect_list(F.struct("n", "value"))).alias("a"))
    return df.select("stream", F.transform("a", lambda x: x["value"]).alias("samples"))


def _machine_sql(c: Hysteresis, source: str) -> str:
    """labelled(stream, n, label) of source(stream, n, score): the machine's states one after the other, then the frames that an onset marks before it,
    then runs that are too short."""
    opened = f"(run + 1 >= {c.onset} AND score >= {c.on})"
    closed = f"(run + 1 > {c.hangover} AND score < {c.off})"
    step = f"""SELECT stream, n, score, CASE WHEN active THEN NOT {closed} ELSE {opened} END AS active, CASE WHEN active AND NOT {closed} AND score < {c.off} THEN run + 1 WHEN NOT active AND NOT {opened} AND score >= {c.on} THEN run + 1 ELSE 0 END AS run, NOT active AND {opened} AS opens"""
    return f"""machine(stream, n, score, active, run, opens) AS ({step} FROM (SELECT stream, n, score, false AS active, 0 AS run FROM {source} WHERE n = 0)
  UNION ALL {step} FROM (SELECT x.stream, x.n, x.score, m.active, m.run FROM machine m JOIN {source} x ON x.stream = m.stream AND x.n = m.n + 1)),
marked AS (SELECT stream, n, active OR coalesce(bool_or(opens) OVER (PARTITION BY stream ORDER BY n ROWS BETWEEN CURRENT ROW AND {c.onset - 1 + c.preroll} FOLLOWING), false) AS label FROM machine),
runs AS (SELECT *, n - row_number() OVER (PARTITION BY stream, label ORDER BY n) AS i FROM marked),
labelled AS (SELECT stream, n, label AND count(*) OVER (PARTITION BY stream, label, i) >= {max(c.minimum, 1)} AS label FROM runs)"""


_MACHINE = Hysteresis(100.0, 40.0, onset=1, hangover=2, preroll=1, minimum=2)


@query(f"WITH RECURSIVE {SIGNAL}, scored AS MATERIALIZED (SELECT stream, n, value AS score FROM signal), {_machine_sql(_MACHINE, 'scored')} SELECT stream, n, label FROM labelled")
def hysteresis_labels(spark, sf_dir):
    df = signals.per_stream(_arrays(spark, sf_dir), lambda x: {"label": kernels.hysteresis(x, _MACHINE)}, {"label": "array<boolean>"})
    return _points(df, "label")


_E = EnergyActivity(frame=SMALL, window=20, machine=Hysteresis(12.0, 9.0, 1, 2, 1, 1))


@query(f"""WITH RECURSIVE {_FRAMES},
raw AS (SELECT f.stream, frame AS n, greatest(10 * log10(sum(value * value) / {SMALL.length} + {float(kernels.TINY)!r}), {_E.least_db}) AS e FROM frames f JOIN signal s ON f.stream = s.stream AND s.n >= frame * {SMALL.hop} AND s.n < frame * {SMALL.hop} + {SMALL.length} GROUP BY ALL),
level AS MATERIALIZED (SELECT stream, n, e, quantile_cont(e, {_E.quantile}) OVER (PARTITION BY stream ORDER BY n ROWS {_E.window - 1} PRECEDING) AS q FROM raw),
floors(stream, n, e, f) AS (SELECT stream, n, e, CASE WHEN q > {_E.start_db} THEN {_E.rising} * {_E.start_db}::DOUBLE + (1 - {_E.rising}::DOUBLE) * q ELSE {_E.falling} * {_E.start_db}::DOUBLE + (1 - {_E.falling}::DOUBLE) * q END FROM level WHERE n = 0
  UNION ALL SELECT x.stream, x.n, x.e, CASE WHEN x.q > f THEN {_E.rising}::DOUBLE * f + (1 - {_E.rising}::DOUBLE) * x.q ELSE {_E.falling}::DOUBLE * f + (1 - {_E.falling}::DOUBLE) * x.q END FROM floors r JOIN level x ON x.stream = r.stream AND x.n = r.n + 1),
scored AS MATERIALIZED (SELECT stream, n, e - f AS score FROM floors), {_machine_sql(_E.machine, 'scored')}
SELECT l.stream, l.n, round(score, 6) AS margin, label FROM labelled l JOIN scored s ON s.stream = l.stream AND s.n = l.n""")
def energy_vad(spark, sf_dir):
    df = signals.per_stream(_arrays(spark, sf_dir), lambda x: {k: v for k, v in kernels.energy_activity(x, _E).items() if k in ("margin", "labels")}, {"margin": "array<double>", "labels": "array<boolean>"})
    return _points(df, "margin", "labels").select("stream", "n", F.round("margin", 6).alias("margin"), F.col("labels").alias("label"))


STATISTICAL = StatisticalActivity(frame=SMALL, fft=16, band=(0.0, 8000.0), machine=Hysteresis(0.8, 0.79, 1, 2, 1, 1))


@query(f"""WITH RECURSIVE {SIGNAL}, sizes AS (SELECT stream, count(*) AS size FROM signal GROUP BY stream),
cells AS (SELECT stream, unnest(range(0, (greatest(ceil((size - {SMALL.length}) / {SMALL.hop}.0), 0) + 1)::BIGINT)) AS frame FROM sizes),
framed AS (SELECT c.stream, frame, o, (0.5 - 0.5 * cos(2 * pi() * o / {SMALL.length})) * coalesce(value, 0) AS y FROM (SELECT * FROM cells, range(0, {SMALL.length}) t(o)) c LEFT JOIN signal s ON s.stream = c.stream AND s.n = frame * {SMALL.hop} + o),
parts AS (SELECT stream, frame, bin, sum(y * cos(2 * pi() * bin * o / {STATISTICAL.fft})) AS re, sum(y * sin(2 * pi() * bin * o / {STATISTICAL.fft})) AS im FROM framed, range(0, {STATISTICAL.fft // 2 + 1}) t(bin) GROUP BY ALL),
spec AS MATERIALIZED (SELECT stream, frame, bin, re * re + im * im AS p FROM parts), {_TRACK},
seen AS MATERIALIZED (SELECT t.stream, t.frame, t.bin, p, noise, least(greatest(p / greatest(noise, {_EPS}), 0), {_MOST}) AS gamma FROM tracked t JOIN spec x ON x.stream = t.stream AND x.frame = t.frame AND x.bin = t.bin),
directed(stream, frame, bin, p, noise, gamma, xi) AS (SELECT stream, frame, bin, p, noise, gamma, least(greatest(gamma - 1, 0), {_MOST}) FROM seen WHERE frame = 0
  UNION ALL SELECT x.stream, x.frame, x.bin, x.p, x.noise, x.gamma, least(greatest({STATISTICAL.memory}::DOUBLE * pow(d.xi / (1 + d.xi), 2) * d.p / greatest(d.noise, {_EPS}) + (1 - {STATISTICAL.memory}::DOUBLE) * greatest(x.gamma - 1, 0), 0), {_MOST})
    FROM directed d JOIN seen x ON x.stream = d.stream AND x.bin = d.bin AND x.frame = d.frame + 1),
scored AS MATERIALIZED (SELECT stream, frame AS n, avg(gamma * xi / (1 + xi) - ln(1 + xi)) AS score FROM directed GROUP BY ALL), {_machine_sql(STATISTICAL.machine, 'scored')}
SELECT l.stream, l.n, round(score, 6) AS margin, label FROM labelled l JOIN scored s ON s.stream = l.stream AND s.n = l.n""")
def statistical_vad(spark, sf_dir):
    df = signals.per_stream(_arrays(spark, sf_dir), lambda x: {k: v for k, v in kernels.statistical_activity(x, STATISTICAL).items() if k in ("margin", "labels")}, {"margin": "array<double>", "labels": "array<boolean>"})
    return _points(df, "margin", "labels").select("stream", "n", F.round("margin", 6).alias("margin"), F.col("labels").alias("label"))


_P = Endpoints(on=0.3, off=0.15, onset=1, hangover=3, preroll=2, least_speech=2, maximum=20)
_RING = f"list_concat(CASE WHEN len(ring) >= {_P.preroll + _P.onset} THEN ring[2:] ELSE ring END, [loud])"
_STEP = f"""SELECT stream, n, active AND NOT ends AS active, CASE WHEN active OR ends THEN 0 ELSE run END AS run, CASE WHEN ends THEN 0 ELSE quiet END AS quiet, CASE WHEN ends THEN 0 ELSE speech END AS speech, CASE WHEN ends THEN 0 ELSE held END AS held,
  CASE WHEN ends THEN CAST([] AS BOOLEAN[]) ELSE ring END AS ring, start, CASE WHEN ends AND speech >= {_P.least_speech} THEN speech END AS found, CASE WHEN ends THEN held END AS total, CASE WHEN ends THEN CASE WHEN silent THEN 'silence' ELSE 'maximum_duration' END END AS reason
FROM (SELECT *, active AND (silent OR held >= {_P.maximum}) AS ends FROM (
  SELECT stream, n, old OR run >= {_P.onset} AS active, run, CASE WHEN old AND NOT loud THEN quiet + 1 ELSE 0 END AS quiet, CASE WHEN old THEN speech + loud::INT ELSE len(list_filter(ring, lambda x: x)) END AS speech,
    CASE WHEN old THEN held + 1 ELSE len(ring) END AS held, ring, CASE WHEN old THEN start ELSE n - len(ring) + 1 END AS start, old AND NOT loud AND quiet + 1 >= {_P.hangover} AS silent
  FROM (SELECT stream, n, loud, active AS old, CASE WHEN active THEN 0 WHEN p >= {_P.on} THEN run + 1 ELSE 0 END AS run, quiet, speech, held, CASE WHEN active THEN ring ELSE {_RING} END AS ring, start FROM ({{source}}))))"""


ENDPOINTS = f"""WITH RECURSIVE {SIGNAL}, chance AS MATERIALIZED (SELECT stream, n, least(greatest(value / 490, 0), 1) AS p, least(greatest(value / 490, 0), 1) >= {_P.off} AS loud FROM signal),
state(stream, n, active, run, quiet, speech, held, ring, start, found, total, reason) AS (
  {_STEP.format(source="SELECT *, false AS active, 0 AS run, 0 AS quiet, 0 AS speech, 0 AS held, CAST([] AS BOOLEAN[]) AS ring, 0 AS start FROM chance WHERE n = 0")}
  UNION ALL {_STEP.format(source="SELECT c.stream, c.n, c.p, c.loud, s.active, s.run, s.quiet, s.speech, s.held, s.ring, s.start FROM state s JOIN chance c ON c.stream = s.stream AND c.n = s.n + 1")}),
ended AS (SELECT stream, start, n + 1 AS stop, found AS speech, total, reason FROM state WHERE found IS NOT NULL
  UNION ALL SELECT stream, start, n + 1, speech, held, 'stream_end' FROM state s WHERE active AND speech >= {_P.least_speech} AND n = (SELECT max(n) FROM chance c WHERE c.stream = s.stream))
SELECT stream, start::BIGINT AS start, stop::BIGINT AS stop, speech::BIGINT AS speech, total::BIGINT AS total, reason FROM ended"""


@query(ENDPOINTS)
def endpoint_segments(spark, sf_dir):
    def detect(x):
        found = endpointing.segments(np.clip(x / 490, 0, 1), _P)
        start, stop, speech, total = (np.array([s[k] for s in found], np.int64) for k in range(4))
        return {"start": start, "stop": stop, "speech": speech, "total": total, "reason": [s.reason for s in found]}

    df = signals.per_stream(_arrays(spark, sf_dir), detect, {"start": "array<long>", "stop": "array<long>", "speech": "array<long>", "total": "array<long>", "reason": "array<string>"})
    return _points(df, "start", "stop", "speech", "total", "reason").drop("n")


_C, _R = Continuity(block=16), Correction(block=16)
_BLOCKS = f"{PAIRS}, blocks AS MATERIALIZED (SELECT stream, k, reference[k * 16 + 1:k * 16 + 16] AS r, estimate[k * 16 + 1:k * 16 + 16] AS e, vad[k + 1] AS vad FROM pairs, range(0, 4) t(k))"
_LIFT = f"SELECT stream, most, k, now, env, power(10, CASE WHEN vad >= {_C.voiced} THEN least(most, greatest(0.0, env - {_C.drop_db} - now)) ELSE 0.0 END / 20) AS gain, before"
_DB = f"20 * log10(sqrt(list_sum(list_transform(e, lambda x: x * x)) / 16 + {_C.least_rms!r}::DOUBLE * {_C.least_rms!r}::DOUBLE))"


_LIFTED = f"""{_BLOCKS}, boosts(variant, most) AS (VALUES {{boosts}}), loud AS MATERIALIZED (SELECT stream, most, k, vad, {_DB} AS now FROM blocks, boosts),
lift(stream, most, k, now, env, gain, before) AS (
  {_LIFT} FROM (SELECT stream, most, k, now, vad, 1.0::DOUBLE AS before, CASE WHEN vad >= {_C.voiced} THEN now END AS env FROM loud WHERE k = 0)
  UNION ALL {_LIFT} FROM (SELECT b.stream, b.most, b.k, b.now, b.vad, l.gain AS before, CASE WHEN b.vad >= {_C.voiced} THEN CASE WHEN l.env IS NULL THEN b.now ELSE greatest(b.now, l.env - {_C.release_db}) END END AS env FROM lift l JOIN loud b ON b.stream = l.stream AND b.most = l.most AND b.k = l.k + 1)),
o AS (SELECT l.stream, variant, k * 16 + i - 1 AS n, e[i] * (before + (gain - before) * (i - 1) / 15) AS y, gain FROM lift l JOIN blocks USING (stream, k) JOIN boosts USING (most), range(1, 17) t(i))"""


@query(f"WITH RECURSIVE {_LIFTED.format(boosts=f'(0, {_C.most_boost_db}::DOUBLE)')} SELECT stream, n, round(least(greatest(y, -1), 1), 6) AS value, round(gain, 6) AS gain FROM o")
def continuity(spark, sf_dir):
    df = signals.per_stream(pairs(spark, sf_dir), lambda x, v: kernels.continuity(x, v, _C), {"samples": "array<double>", "gain": "array<double>"}, ["estimate", "vad"])
    df = df.withColumn("gain", F.expr("transform(samples, (x, i) -> gain[cast(i div 16 as int)])"))
    return _points(df, "samples", "gain").select("stream", "n", F.round("samples", 6).alias("value"), F.round("gain", 6).alias("gain"))


#: Named presets of the enhancement's continuity: the greatest boost in decibels.
CONTINUITY = {"none": 0.0, "3db": 3.0, "6db": 6.0}


@query(f"WITH RECURSIVE {_LIFTED.format(boosts=', '.join(f'({k!r}, {v}::DOUBLE)' for k, v in CONTINUITY.items()))}, s AS (SELECT variant, stream, avg((gain > 1)::INT) AS boosted, sum(n * least(greatest(y, -1), 1)) AS w FROM o GROUP BY ALL) SELECT variant, stream, round(boosted, 6) AS boosted, round(w, 5) AS weighted FROM s")
def continuity_grid(spark, sf_dir):
    """Every stream under every preset."""
    presets = spark.createDataFrame(list(CONTINUITY.items()), "variant string, most double")
    df = pairs(spark, sf_dir).join(F.broadcast(presets), F.lit(True))
    df = df.select(F.struct("variant", "stream").alias("stream"), "estimate", "vad", F.array("most").alias("most"))

    def lift(x, v, most):
        return kernels.continuity(x, v, Continuity(block=16, most_boost_db=float(most[0])))

    out = signals.per_stream(df, lift, {"samples": "array<double>", "gain": "array<double>"}, ["estimate", "vad", "most"])
    weighted = F.aggregate(F.transform("samples", lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    boosted = F.size(F.filter("gain", lambda g: g > 1)) / F.size("gain")
    return out.select("stream.variant", F.col("stream.stream").alias("stream"), F.round(boosted, 6).alias("boosted"), F.round(weighted, 5).alias("weighted"))


#: Named presets of the controller: a fixed strength, and how much of it activity takes away.
CONTROLLERS = {"native": (1.0, 0.0), "fixed_75": (0.75, 0.0), "fixed_50": (0.5, 0.0), "fixed_25": (0.25, 0.0), "activity_15": (1.0, 0.15), "activity_30": (1.0, 0.3), "fixed_75_activity_15": (0.75, 0.15), "fixed_50_activity_30": (0.5, 0.3)}


@query(f"""WITH {PAIRS}, presets(variant, fixed, share) AS (VALUES {', '.join(f'({k!r}, {a}::DOUBLE, {b}::DOUBLE)' for k, (a, b) in CONTROLLERS.items())}),
m AS (SELECT variant, stream, list_transform(reference, lambda x, i: fixed * (1 - share * vad[least((i - 1) // 16, 3) + 1]) * estimate[i] + (1 - fixed * (1 - share * vad[least((i - 1) // 16, 3) + 1])) * x) AS y FROM pairs, presets)
SELECT variant, stream, round(list_sum(list_transform(y, lambda x, i: x * i)), 6) AS weighted FROM m""")
def controller_grid(spark, sf_dir):
    """Every stream under every preset, in expressions."""
    presets = spark.createDataFrame([(k, *v) for k, v in CONTROLLERS.items()], "variant string, fixed double, share double")
    df = pairs(spark, sf_dir).join(F.broadcast(presets), F.lit(True))
    mixed = F.expr("transform(estimate, (e, i) -> fixed * (1 - share * vad[least(cast(i div 16 as int), size(vad) - 1)]) * e + (1 - fixed * (1 - share * vad[least(cast(i div 16 as int), size(vad) - 1)])) * reference[i])")
    return df.withColumn("y", mixed).select("variant", "stream", _weighted("y").alias("weighted"))


def _texts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("stream"), F.coalesce("text", F.lit("")).alias("text"))


def _samples(codes: np.ndarray) -> np.ndarray:
    """Of a text's code points; an empty one is a single 0. Made by tasks, as samples take 8 times the text, and that again for each stream made of them."""
    return ((codes if len(codes) else np.zeros(1, np.uint32)) % 64 - 32.0) / 32.0


@query()
def intelligibility(spark, sf_dir):
    """All texts as streams at 10 kHz, against themselves with their reverse added; those too short for a segment get the measure's least value."""

    def score(codes):
        x = _samples(codes)
        return {"stoi": round(perception.stoi(x, x + 0.3 * x[::-1], 10_000), 6)}

    return signals.per_stream(_texts(spark, sf_dir), score, {"stoi": "double"}, ["text"])


_WANT = f"SELECT stream, k, en, rm, ratio, before, CASE WHEN want > before THEN {_R.attack}::DOUBLE ELSE {_R.release}::DOUBLE END * before + (1 - CASE WHEN want > before THEN {_R.attack}::DOUBLE ELSE {_R.release}::DOUBLE END) * want AS strength FROM (SELECT *, 1 / (1 + exp(-least(greatest((ratio - {_R.threshold_db}) / {_R.scale_db}, -30), 30))) * (1 - {_R.protection}::DOUBLE * vad) AS want FROM (SELECT *, 10 * log10((rm + {_EPS}) / (en + {_EPS})) AS ratio"


@query(f"""WITH RECURSIVE {_BLOCKS}, sums AS MATERIALIZED (SELECT stream, k, vad, list_sum(list_transform(r, lambda x: x * x)) / 16 AS a, list_sum(list_transform(r, lambda x, i: (x - e[i]) * (x - e[i]))) / 16 AS b FROM blocks),
mixed(stream, k, en, rm, ratio, before, strength) AS (
  {_WANT} FROM (SELECT stream, k, vad, a AS en, b AS rm, {_R.start}::DOUBLE AS before FROM sums WHERE k = 0)))
  UNION ALL {_WANT} FROM (SELECT s.stream, s.k, s.vad, {_R.memory}::DOUBLE * m.en + (1 - {_R.memory}::DOUBLE) * s.a AS en, {_R.memory}::DOUBLE * m.rm + (1 - {_R.memory}::DOUBLE) * s.b AS rm, m.strength AS before FROM mixed m JOIN sums s ON s.stream = m.stream AND s.k = m.k + 1)))),
o AS (SELECT m.stream, k * 16 + i - 1 AS n, (before + (strength - before) * (i - 1) / 15) AS s, r[i] AS r, e[i] AS e, strength, ratio FROM mixed m JOIN blocks USING (stream, k), range(1, 17) t(i))
SELECT stream, n, round(s * e + (1 - s) * r, 6) AS value, round(strength, 6) AS strength, round(ratio, 6) AS ratio FROM o""")
def correction_mix(spark, sf_dir):
    df = signals.per_stream(pairs(spark, sf_dir), lambda x, e, v: kernels.correction_mix(x, e, v, _R), {"samples": "array<double>", "strength": "array<double>", "ratio": "array<double>"}, ["reference", "estimate", "vad"])
    per = {c: F.expr(f"transform(samples, (x, i) -> {c}[cast(i div 16 as int)])") for c in ("strength", "ratio")}
    return _points(df.withColumns(per), "samples", "strength", "ratio").select("stream", "n", F.round("samples", 6).alias("value"), F.round("strength", 6).alias("strength"), F.round("ratio", 6).alias("ratio"))


_H = (3 * kernels.low_pass(61, 1 / 3, 5.0)).tolist()


@query(f"WITH {_VECTOR_POINTS}, taps AS (SELECT unnest(range(0, 61)) AS k, unnest([{', '.join(f'{x!r}::DOUBLE' for x in _H)}]) AS h) SELECT stream, 3 * n + k - 30 AS n, round(sum(value * h), 6) AS value FROM points, taps WHERE 3 * n + k - 30 BETWEEN 0 AND 191 GROUP BY ALL")
def resample_streams(spark, sf_dir):
    df = signals.per_stream(vectors(spark, sf_dir), lambda x: {"y": kernels.resample(x, 16000, 48000)}, {"y": "array<double>"})
    return _points(df, "y").select("stream", "n", F.round("y", 6).alias("value"))


@query()
def labelled_mixtures(spark, sf_dir):
    c = Placement(rate=100, seconds=4.0, shortest=0.2, longest=0.6, least_gap=0.1, most_gap=0.5)

    def mix(stream, r, e):
        out = kernels.labelled_mixture([r], [e - r], 5.0, c, np.random.default_rng([20260724, stream]))
        return {"noisy": out["noisy"], "starts": np.array([a for a, _ in out["intervals"]]), "stops": np.array([b for _, b in out["intervals"]])}

    return signals.per_stream(pairs(spark, sf_dir), mix, {"noisy": "array<double>", "starts": "array<long>", "stops": "array<long>"}, ["reference", "estimate"], keyed=True)


@query(f"""WITH {PAIRS}, d AS (SELECT stream, reference AS r, list_transform(reference, lambda x, i: estimate[i] - x) AS d FROM pairs),
s AS (SELECT *, list_avg(list_transform(list_filter(r, lambda x: x <> 0), lambda x: x * x)) AS a, list_avg(list_filter(list_transform(r, lambda x, i: CASE WHEN x <> 0 THEN d[i] * d[i] END), lambda x: x IS NOT NULL)) AS b FROM d),
m AS (SELECT stream, list_transform(r, lambda x, i: x + d[i] * sqrt(a / greatest(b, {_EPS}) / power(10, 0.5::DOUBLE))) AS y FROM s)
SELECT stream, round(list_sum(list_transform(y, lambda x, i: x * i)) * least(1.0, 0.98::DOUBLE / greatest(list_max(list_transform(y, lambda x: abs(x))), {_EPS})), 5) AS weighted FROM m""")
def residual_noise_tracks(spark, sf_dir):
    df = signals.per_stream(pairs(spark, sf_dir), lambda r, e: {"noisy": kernels.activity_mixture(r, e - r, 5.0)}, {"noisy": "array<double>"}, ["reference", "estimate"])
    weighted = F.aggregate(F.transform("noisy", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return df.select("stream", F.round(weighted, 5).alias("weighted"))


@query()
def subband_vad(spark, sf_dir):
    """All texts as streams at 8 kHz: their frames, and how many are active."""
    c = subbands.SubBands(2, 8_000, 10, 10)
    each = lambda texts: [{"frames": len(v), "active": int(v.sum())} for v in subbands.subband_activity_many([_samples(x) for x in texts], c)]
    return signals.per_batch(_texts(spark, sf_dir), each, {"frames": "long", "active": "long"}, ["text"])


class _Linear:
    """A stand-in for a model: sums of a window's samples by their places."""

    signature = {"x": [None, 96]}, {"y": [None, 2]}

    def run(self, batch):
        total = batch.astype(float) @ np.arange(1, 97) / 1000
        return np.stack([total, 1 - total], axis=1)


@query("""WITH v AS (SELECT vec_id AS stream, embedding::DOUBLE[] AS s FROM embeddings), h AS (SELECT stream, s, unnest(range(0, (128 - 96) // 16 + 1)) AS k FROM v),
t AS (SELECT stream, list_sum(list_transform(range(1, 97), lambda i: s[(k * 16 + i - 1) % 64 + 1] * i)) / 1000 AS a FROM h)
SELECT stream, count(*) AS hops, round(avg(a), 6) AS sig_raw, round(avg((-0.08::DOUBLE * a + 1.2::DOUBLE) * a + 0.05::DOUBLE), 6) AS sig, round(avg(1 - a), 6) AS bak_raw, round(avg(0.5::DOUBLE * (1 - a) - 1), 6) AS bak FROM t GROUP BY stream""")
def perceived_scores(spark, sf_dir):
    p = perceived.Protocol({"sig": (-0.08, 1.2, 0.05), "bak": (0.5, -1.0)}, samples=96, hop=16, batch=2, input="x", output="y")
    out = perceived.scored(vectors(spark, sf_dir), _Linear, p)
    return out.select("stream", "hops", *(F.round(c, 6).alias(c) for c in ("sig_raw", "sig", "bak_raw", "bak")))
