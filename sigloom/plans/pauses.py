"""Queries of pauses: windows picked for a noise print, and the hiss that a rendition leaves in its pauses."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from sigloom.functions import hearing
from sigloom.operators import layout, pauses, renditions, spectra
from sigloom.plans import renditions as base
from sigloom.plans import views as v

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


HOP, HOPS, COUNT, SHARE = 4, 3, 4, 0.5


@query(f"""WITH RECURSIVE {v.LONG}, e AS (SELECT track, ix // {HOP} AS h, avg(x * x) AS e FROM signal_long GROUP BY ALL HAVING count(*) = {HOP}),
w AS (SELECT track, h, sqrt(avg(e) OVER o) AS level, count(*) OVER o AS c FROM e WINDOW o AS (PARTITION BY track ORDER BY h ROWS BETWEEN CURRENT ROW AND {HOPS - 1} FOLLOWING)),
q AS (SELECT track, quantile_cont(level, {SHARE}) AS q FROM w WHERE c = {HOPS} GROUP BY track),
k AS (SELECT track, h, level, row_number() OVER (PARTITION BY track ORDER BY level, h) AS k FROM w JOIN q USING (track) WHERE c = {HOPS} AND level <= q),
g AS (SELECT track, k, [h] AS taken FROM k WHERE k = 1 UNION ALL
  SELECT k.track, k.k, CASE WHEN len(list_filter(taken, lambda t: abs(t - k.h) < {HOPS})) = 0 THEN list_append(taken, k.h) ELSE taken END FROM g JOIN k ON k.track = g.track AND k.k = g.k + 1),
t AS (SELECT track, arg_max(taken, k) AS taken FROM g GROUP BY track), m AS (SELECT track, taken, len(taken) AS m, least(len(taken), {COUNT}) AS c FROM t),
s AS (SELECT track, unnest(list_transform(range(0, c), lambda i: taken[(CASE WHEN c = 1 THEN 0 ELSE i * (m - 1) // (c - 1) END) + 1])) AS h FROM m)
SELECT track, h * {HOP} AS start, (h + {HOPS}) * {HOP} AS stop, round(level, 9) AS level FROM s JOIN k USING (track, h)""")
def pause_windows(spark, d):
    """Four windows of each track spread evenly by level over its quieter half, none over another."""
    return pauses.pause_windows(v.signal_long(spark, d), HOP, HOPS, COUNT, SHARE).withColumn("level", F.round("level", 9))


RATE, FRAME = 8000.0, 16
SHORTEST, BLOCK, TAIL, LEAST, SEGMENT, QUIET, PROGRAMME_DB, LEVEL_DB = 2, 4, 2, 2, 10, 0.6, 3.0, 95.0


def _hiss() -> str:
    bands = pauses.bands_of(RATE, FRAME)
    n, scale = len(bands), 2 / (FRAME * float((spectra.hann(FRAME) ** 2).sum()))
    centres = [math.sqrt(lo * hi) for lo, hi, _ in bands]
    hush = [hearing.quiet_db(c) - pauses.QUIET_MARGIN for c in centres]
    vad = [b for b in (renditions.bins_within(*r, RATE, FRAME) for r in renditions.ACTIVE_BANDS) if b]
    rows = " UNION ALL ".join(f"SELECT track, f, {i} AS band, {scale!r}::DOUBLE * {base._within('s', b)} AS src, {scale!r}::DOUBLE * {base._within('o', b)} AS out FROM p" for i, (*_, b) in enumerate(bands))
    active = " UNION ALL ".join(f"SELECT track, f, {i} AS i, {base._within('s', b)} AS e FROM p" for i, b in enumerate(vad))
    known = ", ".join(f"({i}, {pauses.median_share(max(len(b) / pauses.CORRELATED, 0.5), -0.6744897501960817)!r}::DOUBLE, {pauses.median_share(max(len(b) / pauses.CORRELATED, 0.5) * BLOCK)!r}::DOUBLE, {pauses.median_share(max(len(b) / pauses.CORRELATED, 0.5))!r}::DOUBLE, {10 * math.log10(pauses.hiss_weight(c))!r}::DOUBLE, {h!r}::DOUBLE, {c!r}::DOUBLE, {pauses.critical_rate(hi) - pauses.critical_rate(lo)!r}::DOUBLE, {pauses.hiss_weight(c)!r}::DOUBLE)" for i, ((lo, hi, b), c, h) in enumerate(zip(bands, centres, hush)))
    near = ", ".join(f"({i}, {min(max(i + d, 0), n - 1)})" for i in range(n) for d in range(-(pauses.SMOOTH // 2), pauses.SMOOTH // 2 + 1))
    side = lambda s: f"""greatest(coalesce(max({LEVEL_DB} + sm_{s} - hush) FILTER (centre >= {pauses.HISS_FROM}), {LEVEL_DB - pauses.RANGE_DB}), {LEVEL_DB - pauses.RANGE_DB}) AS {s}_margin_db,
  sum(CASE WHEN centre >= {pauses.HISS_FROM} THEN coalesce(greatest(0.08 * pow(10, 0.023 * hush) * (pow(0.5 + 0.5 * pow(10, ({s} + {LEVEL_DB} - hush) / 10), 0.23) - 1), 0), 0) * width * weight ELSE 0 END) AS {s}_sone,
  coalesce(min(hush - {s}) FILTER (centre >= {pauses.ROOM_ONSET[0]} AND centre < {pauses.ROOM_ONSET[1]}), {pauses.RANGE_DB}) AS {s}_room_onset_db, 10 * log10(coalesce(sum({s}_f) FILTER (centre >= {pauses.ROOM_LEVEL[0]} AND centre < {pauses.ROOM_LEVEL[1]}), 0) + 1e-20) - any_value({s}_loud) AS {s}_room"""  # noqa: E731
    names = [f"{s}_{k}" for k in ("margin_db", "sone", "room_onset_db") for s in ("src", "out")]
    return f"""known(band, valley, whole, single, w, hush, centre, width, weight) AS (VALUES {known}), near(band, other) AS (VALUES {near}), bands AS ({rows}), vad AS ({active}),
ends AS (SELECT track, quantile_cont(level, 0.7) AS q, quantile_cont(level, {QUIET}) AS still, quantile_cont(out_level, 0.7) AS r FROM p GROUP BY track),
louds AS (SELECT track, 10 * log10(avg(level * level) FILTER (level >= q) + 1e-20) AS src_loud, 10 * log10(avg(out_level * out_level) FILTER (out_level >= r) + 1e-20) AS out_loud FROM p JOIN ends USING (track) GROUP BY track),
av AS (SELECT track, f, i, 10 * log10((coalesce(lag(e) OVER w, e) + e + coalesce(lead(e) OVER w, e)) / 3 + 1e-20) AS l FROM vad WINDOW w AS (PARTITION BY track, i ORDER BY f)),
act AS (SELECT track, f, bool_or(l > q + 6) AS a FROM av JOIN (SELECT track, i, quantile_cont(l, 0.1) AS q FROM av GROUP BY track, i) USING (track, i) GROUP BY track, f),
speech AS (SELECT track, f, a AS speech FROM act),
st AS (SELECT track, f, speech, f - row_number() OVER (PARTITION BY track, speech ORDER BY f) AS g FROM speech),
masked AS (SELECT track, f FROM (SELECT *, count(*) OVER (PARTITION BY track, speech, g) AS n FROM st) JOIN p USING (track, f) JOIN ends USING (track) WHERE NOT speech AND n >= {SHORTEST} AND level <= still),
mr AS (SELECT track, f, f - row_number() OVER (PARTITION BY track ORDER BY f) AS g FROM masked),
mb AS (SELECT track, f, g, (f - min(f) OVER (PARTITION BY track, g)) // {BLOCK} AS j FROM mr), mc AS (SELECT *, count(*) OVER (PARTITION BY track, g, j) AS n FROM mb),
parts AS (SELECT track, min(f) OVER (PARTITION BY track, g, j) AS pos, f, {BLOCK} AS per FROM mc WHERE n >= {TAIL} UNION ALL SELECT track, f, f, 1 FROM mc WHERE track NOT IN (SELECT track FROM mc WHERE n >= {TAIL})),
means AS (SELECT track, pos, per, band, avg(src) AS src, avg(out) AS out FROM parts JOIN bands USING (track, f) GROUP BY ALL),
vb AS (SELECT track, band, f // {SEGMENT // 5} AS b, quantile_cont(src, 0.25) AS v FROM bands GROUP BY ALL HAVING count(*) = {SEGMENT // 5}),
vs AS (SELECT track, band, b // 5 AS s, quantile_cont(v / valley, 0.5) AS level, 10 * log10(max(v / valley) + 1e-20) - 10 * log10(min(v / valley) + 1e-20) <= {STEADY_DB} AS steady FROM vb JOIN known USING (band) GROUP BY ALL HAVING count(*) = 5),
steady AS (SELECT track, band, quantile_cont(level, 0.5) FILTER (steady) AS level FROM vs GROUP BY track, band HAVING avg(steady::INT) >= 0.5),
held AS (SELECT m.track, m.per, m.band, m.src, m.out FROM means m JOIN known USING (band) LEFT JOIN steady s ON s.track = m.track AND s.band = m.band WHERE NOT (centre >= {pauses.SILENT_FROM} AND coalesce(m.src >= s.level * pow(10, {PROGRAMME_DB} / 10), false))),
floors AS (SELECT track, band, quantile_cont(src, 0.5) / CASE per WHEN 1 THEN single ELSE whole END AS src_f, quantile_cont(out, 0.5) / CASE per WHEN 1 THEN single ELSE whole END AS out_f FROM held JOIN known USING (band) GROUP BY track, per, band, single, whole),
rel AS (SELECT t.track, k.*, src_f, out_f, src_loud, out_loud, CASE WHEN src_f > 0 THEN 10 * log10(src_f) - src_loud END AS src, CASE WHEN out_f > 0 THEN 10 * log10(out_f) - out_loud END AS out
  FROM (SELECT DISTINCT track FROM floors) t CROSS JOIN known k JOIN louds USING (track) LEFT JOIN floors f ON f.track = t.track AND f.band = k.band),
sm AS (SELECT a.track, a.band, CASE WHEN any_value(a.src) IS NOT NULL THEN 10 * log10(sum(pow(10, (b.src + b.w) / 10)) / count(b.src)) END AS sm_src, CASE WHEN any_value(a.out) IS NOT NULL THEN 10 * log10(sum(pow(10, (b.out + b.w) / 10)) / count(b.out)) END AS sm_out
  FROM rel a JOIN near USING (band) JOIN rel b ON b.track = a.track AND b.band = near.other GROUP BY a.track, a.band),
r AS (SELECT track, {side('src')}, {side('out')}, count(src) FILTER (centre >= {pauses.HISS_FROM}) AS n FROM rel JOIN sm USING (track, band) GROUP BY track),
z AS (SELECT t.track, coalesce(c, 0) AS pause_frames, r.* EXCLUDE (track), CASE WHEN coalesce(c, 0) < {LEAST} THEN 'too few pauses' WHEN coalesce(n, 0) = 0 THEN 'programme in every pause' END AS reason
  FROM (SELECT DISTINCT track FROM pair) t LEFT JOIN (SELECT track, count(*) AS c FROM masked GROUP BY track) m ON m.track = t.track LEFT JOIN r ON r.track = t.track)
SELECT track, pause_frames, {', '.join(f'round(CASE WHEN reason IS NULL THEN {c} END, 5) AS {c}' for c in names)}, round(CASE WHEN reason IS NULL THEN out_room - src_room END, 5) AS room_delta_db, reason FROM z"""


STEADY_DB = 3.0
FRAMES = base.FRAMES.replace("sqrt(avg(src * src)) AS level", "sqrt(avg(src * src)) AS level, sqrt(avg(out * out)) AS out_level").replace("SELECT track, f, level,", "SELECT track, f, level, out_level,")


@query(f"WITH {FRAMES}, {_hiss()}")
def hiss_in_pauses(spark, d):
    """Noise that tracks and their two-tap mean leave in the pauses: how far it can be heard, how loud, and the room tone."""
    r = pauses.hiss_in_pauses(base.pair(spark, d), RATE, FRAME, SHORTEST, BLOCK, TAIL, LEAST, SEGMENT, QUIET, programme_db=PROGRAMME_DB, level_db=LEVEL_DB, reach=0, spectrum=base.spectrum)
    return r.select("track", "pause_frames", *[F.round(c, 5).alias(c) for c in r.columns if c.endswith(("_db", "_sone"))], "reason")
