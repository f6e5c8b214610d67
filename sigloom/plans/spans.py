"""Queries on spans of time: runs, merged runs, events among neighbours, windows, chunks, rolling readings, as-of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloom.operators import layout, spans
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


QUIET = v.LONG + """, quiet AS (SELECT track, ix, x, abs(x) <= 0.25 AS quiet FROM signal_long),
marked AS (SELECT *, ix - sum(quiet::INTEGER) OVER (PARTITION BY track ORDER BY ix) AS grp FROM quiet),
islands AS (SELECT track, min(ix) AS start, max(ix) + 1 AS stop, count(*) AS length FROM marked WHERE quiet GROUP BY track, grp)"""
MERGED = QUIET + """, sessions AS (SELECT *, sum(new) OVER (PARTITION BY track ORDER BY start) AS s FROM
  (SELECT *, coalesce(start - lag(stop) OVER (PARTITION BY track ORDER BY start) >= 3, true)::INTEGER AS new FROM islands)),
merged AS (SELECT track, min(start) AS start, max(stop) AS stop, count(*) AS parts FROM sessions GROUP BY track, s)"""


def quiet(spark, d):
    return v.signal_long(spark, d).withColumn("quiet", F.abs("x") <= 0.25)


@query(f"WITH {QUIET} SELECT * FROM islands")
def quiet_islands(spark, d):
    return layout.runs(quiet(spark, d), ["track"], "quiet")


@query(f"WITH {QUIET} SELECT * FROM islands WHERE length BETWEEN 2 AND 6")
def min_length_islands(spark, d):
    return layout.runs(quiet(spark, d), ["track"], "quiet").where(F.col("length").between(2, 6))


@query(f"WITH {MERGED} SELECT * FROM merged")
def merged_islands(spark, d):
    return layout.merged(layout.runs(quiet(spark, d), ["track"], "quiet"), ["track"], 3)


@query(f"""WITH {QUIET}, around AS (
  SELECT track, grp, quiet, ix, max(abs(x)) OVER (PARTITION BY track ORDER BY ix ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS before,
         max(abs(x)) OVER (PARTITION BY track ORDER BY ix ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS after FROM marked),
ends AS (SELECT track, min(ix) AS start, max(ix) + 1 AS stop, arg_min(coalesce(before, 0), ix) AS before, arg_max(coalesce(after, 0), ix) AS after FROM around WHERE quiet GROUP BY track, grp)
SELECT track, start, stop FROM ends WHERE stop - start >= 2 AND before >= 0.6 AND after >= 0.6""")
def bounded_islands(spark, d):
    """Quiet runs with something loud within four samples on either side."""
    q = quiet(spark, d)
    w = layout.in_block(["track"])
    near = layout.own(layout.with_halo(q, 4, 4).withColumns({"before": F.max(F.abs("x")).over(w.rowsBetween(-4, -1)), "after": F.max(F.abs("x")).over(w.rowsBetween(1, 4))}))
    runs = layout.runs(q, ["track"], "quiet").where(F.col("length") >= 2)
    a = near.select("track", F.col("ix").alias("start"), "before").where(F.col("before") >= 0.6)
    b = near.select("track", (F.col("ix") + 1).alias("stop"), "after").where(F.col("after") >= 0.6)
    return runs.join(a, ["track", "start"]).join(b, ["track", "stop"]).select("track", "start", "stop")


@query(f"""WITH {MERGED}, lone AS (SELECT track, start, stop, lag(stop) OVER w AS p, lead(start) OVER w AS n FROM merged WINDOW w AS (PARTITION BY track ORDER BY start))
SELECT track, start, stop FROM lone WHERE (p IS NULL OR start - p >= 8) AND (n IS NULL OR n - stop >= 8)""")
def isolated_events(spark, d):
    m = layout.merged(layout.runs(quiet(spark, d), ["track"], "quiet"), ["track"], 3)
    return spans.isolated(m, ["track"], 8)


@query(f"""WITH {MERGED} SELECT track, start, stop, count(*) OVER (PARTITION BY track ORDER BY start RANGE BETWEEN 40 PRECEDING AND 40 FOLLOWING) AS around
FROM merged QUALIFY around <= 6""")
def unrhythmic_events(spark, d):
    m = layout.merged(layout.runs(quiet(spark, d), ["track"], "quiet"), ["track"], 3)
    return spans.counted_around(m, ["track"], 40).where(F.col("around") <= 6)


@query(f"""WITH {v.FRAME_LEVELS}, b AS (
  SELECT track, fix, level, quantile_cont(level, 0.5) OVER (PARTITION BY track ORDER BY fix ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS base FROM frame_levels),
r AS (SELECT track, fix, 20 * log10((level + 1e-9) / (base + 1e-9)) AS rise FROM b),
f AS (SELECT *, fix - sum((rise >= 1.0)::INTEGER) OVER (PARTITION BY track ORDER BY fix) AS grp FROM r)
SELECT track, min(fix) AS start, max(fix) + 1 AS stop, round(max(rise), 4) AS peak_db FROM f WHERE rise >= 1.0 GROUP BY track, grp HAVING count(*) <= 3""")
def plosive_candidates(spark, d):
    """Short rises of a frame's level over the running median of nine frames."""
    f = spans.rolling_percentile(v.frame_levels(spark, d), ["track"], "fix", "level", 4, 4, 0.5, "base")
    r = f.withColumn("rise", 20 * F.log10((F.col("level") + 1e-9) / (F.col("base") + 1e-9))).withColumn("up", F.col("rise") >= 1.0)
    runs = layout.runs(r, ["track"], "up", "fix").where(F.col("length") <= 3)
    at = runs.withColumn("fix", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)))
    return at.join(r.select("track", "fix", "rise"), ["track", "fix"]).groupBy("track", "start", "stop").agg(F.round(F.max("rise"), 4).alias("peak_db"))


@query(f"""WITH {v.LONG}, s AS (SELECT track, ix, x, (sign(x) <> sign(lag(x) OVER w))::INTEGER AS turn, abs(x - lag(x) OVER w) AS step FROM signal_long WINDOW w AS (PARTITION BY track ORDER BY ix)),
f AS (SELECT track, ix // 8 AS fix, sqrt(avg(x * x)) AS level, avg(coalesce(turn, 0)) AS zcr, avg(coalesce(step, 0)) AS hf FROM s GROUP BY track, ix // 8 HAVING count(*) = 8),
b AS (SELECT track, quantile_cont(level, 0.15) AS p FROM f GROUP BY track)
SELECT track, fix FROM f JOIN b USING (track) WHERE 20 * log10((level + 1e-9) / (p + 1e-9)) >= 3 AND zcr >= 0.5 AND hf >= 0.7""")
def fricative_frames(spark, d):
    s = layout.lagged(v.signal_long(spark, d), ["track"], b=("x", 1))
    turn = F.coalesce((F.signum("x") != F.signum("b")).cast("int"), F.lit(0))
    step = F.coalesce(F.abs(F.col("x") - F.col("b")), F.lit(0.0))
    f = s.groupBy("track", F.floor(F.col("ix") / 8).alias("fix")).agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("level"), F.avg(turn).alias("zcr"), F.avg(step).alias("hf"), F.count("*").alias("n")).where(F.col("n") == 8)
    p = layout.quantiles(f, ["track"], "level", p=0.15)
    return f.join(p, "track").where((20 * F.log10((F.col("level") + 1e-9) / (F.col("p") + 1e-9)) >= 3) & (F.col("zcr") >= 0.5) & (F.col("hf") >= 0.7)).select("track", "fix")


@query(f"""WITH {v.FRAME_PAIRS}, p AS (SELECT track, quantile_cont(ls, 0.7) AS p70 FROM frame_pairs GROUP BY track),
d AS (SELECT track, fix, 20 * log10((lo + 1e-9) / (ls + 1e-9)) AS gain, ls >= 0.5 * p70 AS programme FROM frame_pairs JOIN p USING (track)),
m AS (SELECT track, quantile_cont(gain, 0.5) AS mid FROM d WHERE programme GROUP BY track),
h AS (SELECT track, fix, programme AND gain - mid < -1.5 AS hole FROM d JOIN m USING (track)),
g AS (SELECT *, fix - sum(hole::INTEGER) OVER (PARTITION BY track ORDER BY fix) AS grp FROM h),
r AS (SELECT track, count(*) AS n FROM g WHERE hole GROUP BY track, grp)
SELECT track, count(*) AS dropouts, max(n) AS longest FROM r GROUP BY track""")
def dropout_count(spark, d):
    """Runs of frames in which the output fell below its usual gain while the source had programme."""
    f = v.frame_pairs(spark, d)
    p = layout.quantiles(f, ["track"], "ls", p70=0.7)
    g = f.join(p, "track").select("track", "fix", (20 * F.log10((F.col("lo") + 1e-9) / (F.col("ls") + 1e-9))).alias("gain"), (F.col("ls") >= 0.5 * F.col("p70")).alias("programme"))
    m = layout.quantiles(g.where("programme"), ["track"], "gain", mid=0.5)
    h = g.join(m, "track").withColumn("hole", F.col("programme") & (F.col("gain") - F.col("mid") < -1.5))
    return layout.runs(h, ["track"], "hole", "fix").groupBy("track").agg(F.count("*").alias("dropouts"), F.max("length").alias("longest"))


@query(f"""WITH {v.FRAME_LEVELS} SELECT track, fix, round(quantile_cont(level, 0.5) OVER (PARTITION BY track ORDER BY fix ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS median,
  round(max(level) OVER (PARTITION BY track ORDER BY fix ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS held,
  round(avg(level) OVER (PARTITION BY track ORDER BY fix ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS mean FROM frame_levels""")
def rolling_readings(spark, d):
    """Rolling median, held maximum and moving mean of frame levels."""
    h = layout.with_halo(v.frame_levels(spark, d), 3, 2, "fix")
    w = layout.in_block(["track"], "fix")
    wide = w.rowsBetween(-2, 2)
    return layout.own(h.select("track", "fix", "_blk", "_own", F.round(F.percentile("level", 0.5).over(wide), 6).alias("median"), F.round(F.max("level").over(wide), 6).alias("held"), F.round(F.avg("level").over(w.rowsBetween(-3, 0)), 6).alias("mean")))


@query(f"""WITH {v.FRAME_LEVELS}, low AS (SELECT track, fix, min(level) OVER (PARTITION BY track ORDER BY fix ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS low FROM frame_levels),
shut AS (SELECT track, fix, max(low) OVER (PARTITION BY track ORDER BY fix ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS opened FROM low)
SELECT track, fix, round(opened, 6) AS opened FROM shut""")
def morphological_opening(spark, d):
    h = layout.with_halo(v.frame_levels(spark, d), 6, 6, "fix")
    w = layout.in_block(["track"], "fix")
    low = h.withColumn("low", F.min("level").over(w.rowsBetween(-3, 0)))
    return layout.own(low.withColumn("opened", F.round(F.max("low").over(w.rowsBetween(0, 3)), 6))).select("track", "fix", "opened")


@query(f"""WITH {v.FRAME_LEVELS}, s AS (SELECT track, level - lag(level) OVER (PARTITION BY track ORDER BY fix) AS step FROM frame_levels)
SELECT track, round(quantile_cont(step, 0.9) - quantile_cont(step, 0.1), 6) AS spread FROM s WHERE step IS NOT NULL GROUP BY track""")
def step_spread(spark, d):
    s = layout.lagged(v.frame_levels(spark, d), ["track"], "fix", before=("level", 1)).select("track", (F.col("level") - F.col("before")).alias("step"))
    return layout.quantiles(s, ["track"], "step", a=0.1, b=0.9).select("track", F.round(F.col("b") - F.col("a"), 6).alias("spread"))


@query(f"""WITH {v.FRAME_LEVELS}, f AS (SELECT track, fix, level - avg(level) OVER (PARTITION BY track) AS c FROM frame_levels),
a AS (SELECT x.track, k.lag, sum(x.c * y.c) AS s FROM f x, (SELECT unnest(range(0, 13)) AS lag) k, f y WHERE y.track = x.track AND y.fix = x.fix + k.lag GROUP BY x.track, k.lag),
z AS (SELECT track, s AS s0 FROM a WHERE lag = 0)
SELECT a.track, round(max(s / s0), 6) AS periodicity FROM a JOIN z USING (track) WHERE lag BETWEEN 4 AND 12 AND s0 > 0 GROUP BY a.track""")
def onset_periodicity(spark, d):
    """Largest normalised autocorrelation of the level envelope over lags 4 to 12."""
    return periodicity(v.frame_levels(spark, d))


def periodicity(f):
    f = f.join(f.groupBy("track").agg(F.avg("level").alias("m")), "track").select("track", "fix", (F.col("level") - F.col("m")).alias("c"))
    cols = {f"c{k}": ("c", -k) for k in range(4, 13)}
    s = layout.lagged(f, ["track"], "fix", **cols).groupBy("track").agg(F.sum(F.col("c") * F.col("c")).alias("s0"), *[F.sum(F.col("c") * F.col(k)).alias(k) for k in cols])
    best = F.greatest(*[F.col(k) / F.col("s0") for k in cols])
    return s.where(F.col("s0") > 0).select("track", F.round(best, 6).alias("periodicity"))


@query(f"""WITH {v.EVENTS}, ends AS (SELECT track, max(t) AS last FROM signal_events GROUP BY track),
starts AS (SELECT track, unnest(range(0, least(greatest(floor((last - 432000) / 216000)::BIGINT + 1, 1), 60))) AS k FROM ends),
w AS (SELECT s.track, s.k, avg(e.x) AS level, count(e.x) AS n FROM starts s JOIN signal_events e ON e.track = s.track AND e.t >= s.k * 216000.0 AND e.t < s.k * 216000.0 + 432000 GROUP BY s.track, s.k)
SELECT track, count(*) AS window_count, count_if(level >= 55) AS n_music, count_if(level >= 45) > 0 AS has_dialogue, round(avg((level >= 45)::INTEGER), 4) AS dialogue_ratio FROM w GROUP BY track""")
def temporal_scene_map(spark, d):
    """Sliding windows of five days every two and a half, 60 of a track at most (a limit of the reading), classed and counted."""
    e = v.table(spark, d, "events").select(F.col("user_id").alias("track"), v.seconds("ts").alias("t"), "event_id", F.col("value").alias("x"))
    last = e.groupBy("track").agg(F.max("t").alias("last"))
    k = F.floor(F.col("t") / 216000).cast("int")
    n = F.least(F.greatest(F.floor((F.col("last") - 432000) / 216000) + 1, F.lit(1)), F.lit(60))
    w = e.join(last, "track").withColumn("k", F.explode(F.array(k - 1, k))).where((F.col("k") >= 0) & (F.col("k") < n))
    # a mean on a bar turns on the order of its sum: there the decimals are added, which is exact in any order
    exact = F.sum(F.col("x").try_cast("decimal(28,9)")).cast("double") / F.count("x")
    on_bar = (F.abs(F.col("level") - 55) < 1e-6) | (F.abs(F.col("level") - 45) < 1e-6)
    g = w.groupBy("track", "k").agg(F.avg("x").alias("level"), exact.alias("exact"), F.count(F.col("x").try_cast("decimal(28,9)")).alias("m"), F.count("x").alias("n"))
    g = g.withColumn("level", F.when(on_bar & (F.col("m") == F.col("n")), F.col("exact")).otherwise(F.col("level")))
    return g.groupBy("track").agg(F.count("*").alias("window_count"), F.count_if(F.col("level") >= 55).alias("n_music"), (F.count_if(F.col("level") >= 45) > 0).alias("has_dialogue"), F.round(F.avg((F.col("level") >= 45).cast("int")), 4).alias("dialogue_ratio"))


@query("""SELECT event_type AS track, epoch_us(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01')) // 1000000 AS start_s, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL""")
def tumbling_windows(spark, d):
    e = v.table(spark, d, "events").groupBy(F.col("event_type").alias("track"), F.window(F.col("ts"), "6 hours").alias("w"))
    start = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01', w.start)")
    return e.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).select("track", start.alias("start_s"), "n", "mean")


@query("""WITH s AS (SELECT user_id, ts, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL '6 hours')::INTEGER AS new FROM events),
g AS (SELECT user_id, ts, sum(coalesce(new, 1)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id AS track, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS last_us, count(*) AS n FROM g GROUP BY user_id, k""")
def session_gaps(spark, d):
    us = lambda c: F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', {c})")
    g = v.table(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"))
    return g.select(F.col("user_id").alias("track"), us("a").alias("start_us"), us("b").alias("last_us"), "n")


@query(f"""WITH {v.LONG}, n AS (SELECT track, count(*) AS frames FROM signal_long GROUP BY track),
c AS (SELECT track, frames, (ceil(ceil(frames / ceil(frames / (200.0 - 20))) / 8) * 8)::BIGINT AS core FROM n WHERE frames > 200),
s AS (SELECT track, frames, core, unnest(range(0, frames, core)) AS start FROM c)
SELECT track, start, least(start + core, frames) AS core_stop, greatest(start - 20, 0) AS read_start, least(start + core + 20, frames) AS read_stop FROM s""")
def chunk_plan(spark, d):
    """Overlapping chunks: cores of one size, a multiple of the stride, with context on both sides; none for short tracks."""
    n = v.signal_long(spark, d).groupBy("track").agg(F.count("*").alias("frames"))
    return spans.chunk_plan(n, limit=200, overlap=20, stride=8)


@query(f"""WITH {v.LONG}, m AS (SELECT track, ix, x, ix // 50 AS c, ix % 50 AS o, max(ix) OVER (PARTITION BY track) AS last FROM signal_long)
SELECT track, ix, round(CASE WHEN c > 0 AND o < 10 THEN (1 - (o + 0.5) / 10) * (x * sqrt(1 + 0.01 * (c - 1))) + ((o + 0.5) / 10) * (x * sqrt(1 + 0.01 * c)) ELSE x * sqrt(1 + 0.01 * c) END, 6) AS y FROM m""")
def crossfade_join(spark, d):
    """Chunks of 50 samples, each with its own gain, joined by a linear fade over ten."""
    s = v.signal_long(spark, d)
    chunk = F.floor(F.col("ix") / 50)
    copies = s.withColumn("c", F.explode(F.when((F.col("ix") % 50 < 10) & (chunk > 0), F.array(chunk - 1, chunk)).otherwise(F.array(chunk))))
    return spans.crossfaded(copies.withColumn("y", F.col("x") * F.sqrt(1 + 0.01 * F.col("c"))), 50, 10).select("track", "ix", F.round("y", 6).alias("y"))


@query("""WITH e AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type <> 'click'),
a AS (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY user_id, ts),
k AS (SELECT a.user_id, a.ts, e.value FROM a JOIN events e USING (event_id)),
p AS (SELECT e.*, k.ts AS t0, k.value AS v0 FROM e ASOF LEFT JOIN k ON e.user_id = k.user_id AND e.ts >= k.ts),
n AS (SELECT p.*, k.ts AS t1, k.value AS v1 FROM p ASOF LEFT JOIN k ON p.user_id = k.user_id AND p.ts <= k.ts)
SELECT event_id, round(CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL OR t1 = t0 THEN v0
  ELSE v0 + (v1 - v0) * ((epoch_us(ts) - epoch_us(t0)) / (epoch_us(t1) - epoch_us(t0))) END, 6) AS anchor FROM n""")
def asof_interpolate(spark, d):
    """The value of the clicks around each other event of a user, interpolated in time; the nearest at the ends."""
    e = v.table(spark, d, "events").withColumn("us", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', ts)"))
    points = e.where(F.col("event_type") != "click").select("user_id", "us", "event_id")
    anchors = e.where(F.col("event_type") == "click").groupBy("user_id", "us").agg(F.max_by("value", "event_id").alias("value"))
    return spans.interpolated(points, anchors, "user_id", "us", "value", 86_400_000_000).select("event_id", F.round("value", 6).alias("anchor"))


@query("""SELECT e.event_id, count(b.event_id) AS near FROM events e LEFT JOIN events b ON b.event_type = 'error' AND b.ts BETWEEN e.ts - INTERVAL '30 minutes' AND e.ts + INTERVAL '30 minutes' AND b.event_id <> e.event_id
WHERE e.event_type = 'purchase' GROUP BY e.event_id""")
def interval_count(spark, d):
    """Errors within half an hour of each purchase."""
    e = v.table(spark, d, "events").select("event_id", "event_type", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', ts)").alias("us"))
    return spans.count_within(e.where(F.col("event_type") == "purchase"), e.where(F.col("event_type") == "error"), "event_id", "us", 1_800_000_000, 3_600_000_000)


@query(f"""WITH {v.LONG}, w AS (SELECT track, ix // 40 AS k, sqrt(avg(x * x)) AS level FROM signal_long GROUP BY track, ix // 40 HAVING count(*) = 40)
SELECT track, arg_min(k * 40, {{'level': level, 'k': k}}) AS start, round(min(level), 6) AS level FROM w WHERE level > 0 GROUP BY track""")
def quietest_window(spark, d):
    g = v.signal_long(spark, d).groupBy("track", F.floor(F.col("ix") / 40).alias("k")).agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("level"), F.count("*").alias("n"))
    g = g.where((F.col("n") == 40) & (F.col("level") > 0))
    return g.groupBy("track").agg(F.min_by(F.col("k") * 40, F.struct("level", "k")).alias("start"), F.round(F.min("level"), 6).alias("level"))


@query(f"""WITH {v.LONG}, r AS (SELECT track, ix, x FROM signal_long)
SELECT track, max(step) AS last, count_if(rising) AS rises FROM (
  SELECT track, ix, floor(x * 100)::INTEGER AS step, x > max(x) OVER (PARTITION BY track ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rising FROM r) GROUP BY track""")
def running_maximum(spark, d):
    """Samples above all before them in their track: running maxima in two levels, of blocks and inside blocks."""
    return spans.rises(v.signal_long(spark, d), ["track"], "ix", "x")
