"""Queries of renditions against their source: high bands, hiss under the programme, whole-file readings, hum taken off."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigloom.functions.levels import power_spectrum
from sigloom.operators import defects, hum, layout, renditions, spectra
from sigloom.plans import views as v

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Frames are short here, so that bins of 2 kHz reach 16 kHz.
RATE, FRAME, WINDOW = 32000.0, 16, 32


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def spectrum(x: Column, n: int) -> Column:
    """Power spectrum of a windowed array, by built-in functions."""
    windowed = F.zip_with(x, F.array(*[F.lit(float(w)) for w in spectra.hann(n)]), lambda a, w: a * w)
    return F.transform(F.array(windowed), lambda a: power_spectrum(a, n))[0]


def _power(x: str, n: int) -> str:
    part = lambda f: f"pow(list_sum(list_transform(range(0, {n}), lambda i: {x}[i + 1] * {f}(k * i * (2 * pi() / {n})))), 2)"
    return f"list_transform(range(0, {n // 2 + 1}), lambda k: {part('cos')} + {part('sin')})"


def _within(p: str, bins: list[int]) -> str:
    return "(" + " + ".join(f"{p}[{k + 1}]" for k in bins) + ")" if bins else "0"


def pair(spark, d):
    """track, ix, src, out: the long tracks and their two-tap mean."""
    s = layout.lagged(v.signal_long(spark, d), ["track"], before=("x", 1))
    return s.select("track", "ix", F.col("x").alias("src"), (0.5 * F.col("x") + 0.5 * F.coalesce("before", "x")).alias("out"))


PAIR = v.LONG + ", pair AS (SELECT track, ix, x AS src, 0.5 * x + 0.5 * coalesce(lag(x) OVER (PARTITION BY track ORDER BY ix), x) AS out FROM signal_long)"
HANN = f"(0.5 - 0.5 * cos(2 * pi() * (ix % {FRAME}) / {FRAME}))"
FRAMES = PAIR + f""", fr AS (SELECT track, ix // {FRAME} AS f, list(src * {HANN} ORDER BY ix) AS s, list(out * {HANN} ORDER BY ix) AS o, list((src + out) * {HANN} ORDER BY ix) AS b, sqrt(avg(src * src)) AS level
  FROM pair GROUP BY track, ix // {FRAME} HAVING count(*) = {FRAME}),
p AS (SELECT track, f, level, {_power('s', FRAME)} AS s, {_power('o', FRAME)} AS o, {_power('b', FRAME)} AS b FROM fr),
loud AS (SELECT p.* FROM p JOIN (SELECT track, quantile_cont(level, 0.7) AS q FROM p GROUP BY track) USING (track) WHERE level >= q)"""


def _high(band: str) -> str:
    lo, hi = renditions.HIGH_BANDS[band]
    bins, body = renditions.bins_within(lo, hi, RATE, FRAME, renditions.SCREEN_LINES), renditions.bins_within(*renditions.BODY, RATE, FRAME)
    ratio = lambda c: f"round(10 * log10((avg({_within(c, bins)}) + 1e-20) / (avg({_within(c, body)}) + 1e-20)), 5)"
    return f"SELECT track, '{band}' AS band, {ratio('s')} AS src_db, {ratio('o')} AS out_db FROM loud GROUP BY track"


@query(f"WITH {FRAMES} " + " UNION ALL ".join(_high(b) for b in renditions.HIGH_BANDS))
def high_ratios(spark, d):
    """Bands over the body in the loud frames, of tracks and of their two-tap mean."""
    r = renditions.high_ratios(pair(spark, d), RATE, FRAME, spectrum=spectrum)
    return r.select("track", "band", F.round("src_db", 5).alias("src_db"), F.round("out_db", 5).alias("out_db"))


def _hiss() -> str:
    bands = renditions.hiss_bands(RATE, FRAME)
    match = renditions.bins_within(*renditions.MATCHED, RATE, FRAME)
    vad = [b for b in (renditions.bins_within(*r, RATE, FRAME) for r in renditions.ACTIVE_BANDS) if b]
    known = ", ".join(f"({i}, {lo!r}::DOUBLE, {hi!r}::DOUBLE, {renditions.readable_db(len(b), FRAME)!r}::DOUBLE)" for i, (_, lo, hi, b) in enumerate(bands))
    rows = " UNION ALL ".join(f"SELECT track, f, {i} AS band, {_within('s', b)} AS src, {_within('o', b)} AS out FROM p" for i, (_, _, _, b) in enumerate(bands))
    active = " UNION ALL ".join(f"SELECT track, f, {i} AS i, {_within('s', b)} AS e FROM p" for i, b in enumerate(vad))
    cross = f"sum(({_within('b', match)} - {_within('s', match)} - {_within('o', match)}) / 2)"
    return f"""known(band, lo, hi, bar) AS (VALUES {known}), bands AS ({rows}), vad AS ({active}),
fit AS (SELECT track, {cross} / sum({_within('o', match)}) AS gain, {cross} / sqrt(sum({_within('o', match)}) * sum({_within('s', match)})) AS r FROM loud GROUP BY track),
av AS (SELECT track, f, i, 10 * log10((coalesce(lag(e) OVER w, e) + e + coalesce(lead(e) OVER w, e)) / 3 + 1e-20) AS l FROM vad WINDOW w AS (PARTITION BY track, i ORDER BY f)),
act AS (SELECT track, f, bool_or(l > q + 3) AS a FROM av JOIN (SELECT track, i, quantile_cont(l, 0.1) AS q FROM av GROUP BY track, i) USING (track, i) GROUP BY track, f),
speech AS (SELECT track, f, bool_or(a) OVER (PARTITION BY track ORDER BY f ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS speech FROM act),
near AS (SELECT track, f, band, speech, quantile_cont(CASE WHEN speech THEN src END, 0.1) OVER w AS ls, quantile_cont(CASE WHEN speech THEN out END, 0.1) OVER w AS lo_, count(*) FILTER (speech) OVER w AS n, count(*) OVER w AS m
  FROM bands JOIN speech USING (track, f) WINDOW w AS (PARTITION BY track, band ORDER BY f ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)),
floors AS (SELECT track, band, quantile_cont(ls, 0.5) AS src, quantile_cont(lo_, 0.5) AS out FROM near WHERE speech AND 2 * n >= m GROUP BY track, band HAVING count(*) >= 5),
per AS (SELECT track, band, lo, hi, bar, 10 * log10(src + 1e-20) AS s, 10 * log10(out * gain * gain + 1e-20) AS o FROM floors JOIN known USING (band) JOIN fit USING (track)),
deltas AS (SELECT track, quantile_cont(o - s, 0.5) FILTER (s > bar) AS median_delta, 10 * log10(sum(pow(10, o / 10)) FILTER (s > bar AND hi <= {renditions.PRESENCE}) + 1e-20) - 10 * log10(sum(pow(10, s / 10)) FILTER (s > bar AND hi <= {renditions.PRESENCE}) + 1e-20) AS presence_delta FROM per GROUP BY track),
gaps AS (SELECT track, quantile_cont(mid - low, 0.5) AS gap FROM (SELECT track, band, quantile_cont(10 * log10(src + 1e-20), 0.1) AS low, quantile_cont(10 * log10(src + 1e-20), 0.5) AS mid FROM bands GROUP BY track, band) JOIN known USING (band) WHERE lo >= {renditions.STEADY} AND low > bar GROUP BY track),
shares AS (SELECT track, avg(speech::INT) AS share, count(*) AS frames FROM speech GROUP BY track),
verdicts AS (SELECT *, CASE WHEN coalesce(frames, 0) < 5 THEN 'too short to read' WHEN r < 0.5 OR gain <= 0 THEN 'the rendition does not follow its source' WHEN d.track IS NULL THEN 'too little programme to read the floor under' END AS reason
  FROM (SELECT DISTINCT track FROM pair) t LEFT JOIN shares USING (track) LEFT JOIN fit USING (track) LEFT JOIN deltas d USING (track) LEFT JOIN gaps USING (track))
SELECT track, round(CASE WHEN reason IS NULL THEN gap END, 5) AS floor_gap_db, round(CASE WHEN reason IS NULL THEN median_delta END, 5) AS median_delta_db, round(CASE WHEN reason IS NULL THEN presence_delta END, 5) AS presence_delta_db,
  round(CASE WHEN reason IS NULL THEN 20 * log10(gain) END, 5) AS gain_db, round(CASE WHEN reason IS NULL THEN r END, 6) AS correlation, round(CASE WHEN reason IS NULL THEN share END, 6) AS share, reason FROM verdicts"""


@query(f"WITH {FRAMES}, {_hiss()}")
def hiss_under_programme(spark, d):
    """What the two-tap mean of each track keeps of its hiss."""
    r = renditions.hiss_under_programme(pair(spark, d), RATE, FRAME, reach=1, half=6, least=5, margin_db=3.0, spectrum=spectrum)
    return r.select("track", *[F.round(c, 5).alias(c) for c in ("floor_gap_db", "median_delta_db", "presence_delta_db", "gain_db")], F.round("correlation", 6).alias("correlation"), F.round("share", 6).alias("share"), "reason")


def stereo(spark, d):
    """track, ix, left, right: a line item's price and the same less the next one's, both scaled."""
    x = layout.lagged(v.signal_long(spark, d), ["track"], after=("x", -1))
    return x.select("track", "ix", F.col("x").alias("left"), (F.coalesce(F.col("after"), F.lit(0.0)) * 0.5).alias("right"))


STEREO = v.LONG + ", stereo AS (SELECT track, ix, x AS left_, coalesce(lead(x) OVER (PARTITION BY track ORDER BY ix), 0) * 0.5 AS right_ FROM signal_long)"
LINE, MAINS, RUMBLE = 9000.0, 4000.0, 3000.0


def _peak(hz: float) -> str:
    at = round(hz * WINDOW / RATE)
    width = min(20, at - 1, WINDOW // 2 - at - 1)
    around = [*range(at - width, at - 1), *range(at + 2, at + 2 + width)]
    return f"psd[{at + 1}] / (list_aggregate([{', '.join(f'psd[{k + 1}]' for k in around if k <= WINDOW // 2)}], 'median') + 1e-12)"


def _file(samples: str, name: str) -> str:
    """Common table expression ``name``: readings of ``samples`` (track, ix, left_, right_)."""
    hann = f"(0.5 - 0.5 * cos(2 * pi() * i / {WINDOW}))"
    scale = 1 / (RATE * float((spectra.hann(WINDOW) ** 2).sum()))
    return f"""{name}_w AS (SELECT track, max(greatest(abs(left_), abs(right_))) AS peak, sqrt(sum(left_ * left_ + right_ * right_) / (2 * count(*))) AS rms, sqrt(avg(left_ * left_)) AS l, sqrt(avg(right_ * right_)) AS r, count(*) AS n FROM {samples} GROUP BY track),
{name}_h AS (SELECT track, ix // 8 AS f, sum(pow((left_ + right_) / 2, 2)) AS e FROM {samples} GROUP BY track, ix // 8 HAVING count(*) = 8),
{name}_f AS (SELECT a.track, quantile_cont(sqrt((a.e + b.e) / 16), 0.1) AS floor FROM {name}_h a JOIN {name}_h b ON a.track = b.track AND b.f = a.f + 1 JOIN {name}_w w ON w.track = a.track WHERE a.f * 8 < w.n - 16 GROUP BY a.track),
{name}_g AS (SELECT track, unnest(range(greatest(ceil((ix - {WINDOW - 1}) / {WINDOW / 2}), 0)::BIGINT, (ix // {WINDOW // 2}) + 1)) AS f, ix, (left_ + right_) / 2 AS x FROM {samples}),
{name}_x AS (SELECT track, f, list(x - m ORDER BY ix) AS x FROM (SELECT *, avg(x) OVER (PARTITION BY track, f) AS m FROM {name}_g) GROUP BY track, f HAVING count(*) = {WINDOW}),
{name}_y AS (SELECT track, f, list_transform(range(0, {WINDOW}), lambda i: x[i + 1] * {hann}) AS y FROM {name}_x),
{name}_b AS (SELECT track, bin, avg(p) * {scale!r}::DOUBLE * CASE WHEN bin IN (0, {WINDOW // 2}) THEN 1 ELSE 2 END AS p FROM (SELECT track, unnest(range(0, {WINDOW // 2 + 1})) AS bin, unnest({_power('y', WINDOW)}) AS p FROM {name}_y) GROUP BY track, bin),
{name}_p AS (SELECT track, list(p ORDER BY bin) AS psd FROM {name}_b GROUP BY track),
{name} AS (SELECT w.track, 20 * log10(peak + 1e-9) AS peak_db, 20 * log10(rms + 1e-9) AS rms_db, 20 * log10(CASE WHEN n > 16 AND floor IS NOT NULL THEN floor ELSE rms END + 1e-9) AS floor_db, 20 * log10(rms + 1e-9) - 20 * log10(CASE WHEN n > 16 AND floor IS NOT NULL THEN floor ELSE rms END + 1e-9) AS snr_db,
  {_peak(LINE)} AS whistle_ratio, {_peak(MAINS)} AS hum_ratio, 100 * list_sum(psd[1:{round(RUMBLE * WINDOW / RATE)}]) / (list_sum(psd) + 1e-12) AS rumble_pct, abs(20 * log10((l + 1e-9) / (r + 1e-9))) AS balance_db
  FROM {name}_w w LEFT JOIN {name}_f USING (track) LEFT JOIN {name}_p USING (track))"""


READINGS = ("peak_db", "rms_db", "floor_db", "snr_db", "whistle_ratio", "hum_ratio", "rumble_pct", "balance_db")


def _read(x):
    return renditions.file_readings(x, RATE, WINDOW, LINE, MAINS, RUMBLE, 16, spectrum)


@query(f"WITH {STEREO}, {_file('stereo', 'r')} SELECT track, " + ", ".join(f"round({c}, 5) AS {c}" for c in READINGS) + " FROM r")
def file_readings(spark, d):
    """Peak, level, floor, ratios and balance of each track."""
    return _read(stereo(spark, d)).select("track", *[F.round(c, 5).alias(c) for c in READINGS])


@query(f"""WITH {STEREO}, mono AS (SELECT track, ix, (left_ + coalesce(lag(left_) OVER (PARTITION BY track ORDER BY ix), left_)) / 2 AS left_, right_ FROM stereo), {_file('stereo', 'b')}, {_file('mono', 'a')}
SELECT track, round(a.snr_db - b.snr_db, 5) AS snr_gain_db, round(b.floor_db - a.floor_db, 5) AS noise_reduction_db, round(b.rumble_pct - a.rumble_pct, 5) AS rumble_reduction_pct, round(b.balance_db - a.balance_db, 5) AS balance_gain_db,
  round(b.whistle_ratio / greatest(a.whistle_ratio, 0.05), 5) AS whistle_attenuation, round(b.hum_ratio / greatest(a.hum_ratio, 0.05), 5) AS hum_attenuation FROM b JOIN a USING (track)""")
def file_improvements(spark, d):
    """What a two-tap mean of the left channel improves."""
    x = layout.cut(stereo(spark, d))
    smooth = layout.lagged(x, ["track"], before=("left", 1)).select("track", "ix", ((F.col("left") + F.coalesce("before", "left")) / 2).alias("left"), "right")
    r = renditions.improvements(_read(x), _read(smooth))
    return r.select("track", *[F.round(c, 5).alias(c) for c in r.columns if c != "track"])


@query()
def hum_removed(spark, d):
    """Levels of each track with an injected hum, before and after its planned lines are taken off."""
    x = layout.cut(defects.injected(v.signal_long(spark, d), "hum", level=0.5, freq=0.05))
    lines = spectra.hum_plan(x, 1000.0, count=8, core=4, window=64, hop=4, margin=10.0)
    y = hum.lines_removed(x, lines, 1000.0, window=64, hop=16, base=4.0, least_frames=4)
    both = x.join(y, ["track", "ix"])
    return both.groupBy("track").agg(*[F.round(F.sqrt(F.avg(F.col(c) * F.col(c))), 6).alias(n) for c, n in (("x", "before"), ("y", "after"))], F.count_if(F.col("x") != F.col("y")).alias("changed"))
