"""Further detectors, paired readings, guards and tuning-loop queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sigloom.functions.levels import bark, quiet_threshold_db
from sigloom.operators import layout, transforms
from sigloom.plans import views as v
from sigloom.plans.scoring import FLAT, TOTALS, filled, totals
from sigloom.plans.signal_work import WELCH, frame_powers, welch
from sigloom.plans.signals import spectra

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {v.LONG}, n AS (SELECT track, count(*) AS n FROM signal_long GROUP BY track), o AS (SELECT track, n, unnest(range(0, 4)) AS k FROM n),
b AS (SELECT DISTINCT track, CASE WHEN n <= 160 THEN 0 ELSE ((n - 40) * k) // 3 END AS start, CASE WHEN n <= 160 THEN least(n, 40) ELSE 40 END AS len FROM o)
SELECT b.track, b.start, count(*) AS n, round(avg(x), 6) AS mean FROM b JOIN signal_long s ON s.track = b.track AND s.ix >= b.start AND s.ix < b.start + b.len GROUP BY ALL""")
def block_sample(spark, d):
    """Four blocks evenly spread over a long track, the beginning of a short one."""
    s = v.signal_long(spark, d)
    n = s.groupBy("track").agg(F.count("*").alias("n"))
    long_ = F.col("n") > 160
    starts = F.when(long_, F.array(*[F.floor((F.col("n") - 40) * k / 3) for k in range(4)])).otherwise(F.array(F.lit(0).cast("long")))
    b = n.select("track", F.explode(F.array_distinct(starts)).alias("start"), F.when(long_, 40).otherwise(F.least("n", F.lit(40))).alias("len"))
    at = b.withColumn("ix", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)))
    return at.join(s, ["track", "ix"]).groupBy("track", "start").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean"))


@query(f"""WITH {v.FRAME_PAIRS}, n AS (SELECT track, min(fix) AS a, max(fix) - 2 AS b FROM frame_pairs GROUP BY track)
SELECT s.track, s.fix, round(20 * log10((o.lo + 1e-9) / (s.ls + 1e-9)), 5) AS gain_db FROM frame_pairs s JOIN frame_pairs o ON o.track = s.track AND o.fix = s.fix + 2""")
def zip_join_frames(spark, d):
    """Frames of source and output by position, after taking a lag of two frames out."""
    f = v.frame_pairs(spark, d)
    o = f.select("track", (F.col("fix") - 2).alias("fix"), F.col("lo").alias("o"))
    return f.join(o, ["track", "fix"]).select("track", "fix", F.round(20 * F.log10((F.col("o") + 1e-9) / (F.col("ls") + 1e-9)), 5).alias("gain_db"))


@query(f"""WITH {v.FRAME_LEVELS}, b AS (SELECT track, fix // 4 AS sub, min(level * level) AS low, count(*) AS n FROM frame_levels GROUP BY ALL),
m AS (SELECT track, sub, 1.5 * min(low) OVER (PARTITION BY track ORDER BY sub RANGE BETWEEN 3 PRECEDING AND CURRENT ROW) AS floor FROM b)
SELECT track, sub, round(10 * log10(floor + 1e-12), 5) AS floor_db FROM m""")
def minimum_statistics(spark, d):
    """Noise floor as the minimum energy over the last four sub-windows of four frames, with its bias made up."""
    b = v.frame_levels(spark, d).groupBy("track", F.floor(F.col("fix") / 4).alias("sub")).agg(F.min(F.col("level") * F.col("level")).alias("low"))
    h = layout.with_halo(b, 3, 0, "sub")
    w = layout.in_block(["track"], "sub").rangeBetween(-3, 0)
    return layout.own(h.withColumn("floor_db", F.round(10 * F.log10(1.5 * F.min("low").over(w) + 1e-12), 5))).select("track", "sub", "floor_db")


@query(f"""WITH {WELCH}, t AS (SELECT track, sum(p) AS total FROM psd GROUP BY track), c AS (SELECT track, bin, sum(p) OVER (PARTITION BY track ORDER BY bin) AS upto FROM psd)
SELECT c.track, min(bin)::INTEGER AS bandwidth_bin FROM c JOIN t USING (track) WHERE upto >= 0.9 * total GROUP BY c.track""")
def programme_bandwidth(spark, d):
    """The lowest bin below which nine tenths of the power lie."""
    p = welch(spark, d)
    c = p.withColumn("upto", F.sum("p").over(Window.partitionBy("track").orderBy("bin")))  # 17 bins a track
    t = p.groupBy("track").agg(F.sum("p").alias("total"))
    return c.join(t, "track").where(F.col("upto") >= 0.9 * F.col("total")).groupBy("track").agg(F.min("bin").alias("bandwidth_bin"))


@query(f"""WITH {WELCH}, k AS (SELECT track, arg_max(bin, p) AS peak, max(p) AS top, quantile_cont(p, 0.5) AS mid FROM psd WHERE bin BETWEEN 2 AND 14 GROUP BY track)
SELECT k.track, k.peak::INTEGER AS peak, round(top / mid, 5) AS contrast, count_if(p.p >= top / 2) AS width FROM k JOIN psd p ON p.track = k.track AND p.bin BETWEEN k.peak - 2 AND k.peak + 2 GROUP BY ALL""")
def enclosure_resonance(spark, d):
    """Strongest bin of a band: its contrast to the band's median, and how many bins around reach half of it."""
    p = welch(spark, d)
    k = p.where(F.col("bin").between(2, 14)).groupBy("track").agg(F.max_by("bin", "p").alias("peak"), F.max("p").alias("top"), F.percentile("p", 0.5).alias("mid"))
    near = p.join(k, "track").where(F.abs(F.col("bin") - F.col("peak")) <= 2)
    return near.groupBy("track", "peak", F.round(F.col("top") / F.col("mid"), 5).alias("contrast")).agg(F.count_if(F.col("p") >= F.col("top") / 2).alias("width"))


@query(f"""WITH {v.FRAME_PAIRS}, q AS (SELECT track, quantile_cont(ls, 0.2) AS floor FROM frame_pairs GROUP BY track)
SELECT track, fix, round(CASE WHEN ls > 2 * floor THEN 0.0 ELSE greatest(-12.0, least(0.0, 20 * log10((1.5 * floor + 1e-9) / (lo + 1e-9)))) END, 5) AS cut_db FROM frame_pairs JOIN q USING (track)""")
def burst_ceiling(spark, d):
    """Cut, at most 12 dB, that keeps a pause's output below a ceiling over the source's floor."""
    f = v.frame_pairs(spark, d)
    q = layout.quantiles(f, ["track"], "ls", floor=0.2)
    cut = F.greatest(F.lit(-12.0), F.least(F.lit(0.0), 20 * F.log10((1.5 * F.col("floor") + 1e-9) / (F.col("lo") + 1e-9))))
    return f.join(q, "track").select("track", "fix", F.round(F.when(F.col("ls") > 2 * F.col("floor"), 0.0).otherwise(cut), 5).alias("cut_db"))


@query(f"""WITH {WELCH}, b AS (SELECT track, bin, p, 10 * log10(p + 1e-12) + 40 AS level, 3.64 * pow(0.25 * (bin + 1), -0.8) - 6.5 * exp(-0.6 * pow(0.25 * (bin + 1) - 3.3, 2)) + 1e-3 * pow(0.25 * (bin + 1), 4) AS quiet,
  13 * atan(0.00076 * 250.0 * (bin + 1)) + 3.5 * atan(pow(250.0 * (bin + 1) / 7500, 2)) AS z FROM psd),
m AS (SELECT a.track, a.bin, a.level, greatest(max(o.level - 14.5 - CASE WHEN o.z < a.z THEN 10 * (a.z - o.z) ELSE 27 * (o.z - a.z) END), a.quiet) AS mask FROM b a JOIN b o ON o.track = a.track AND o.bin <> a.bin GROUP BY a.track, a.bin, a.level, a.quiet)
SELECT track, count_if(level > mask) AS audible, round(max(level - mask), 4) AS margin_db FROM m GROUP BY track""")
def masking_margin(spark, d):
    """Bins that stand above what the others mask, and above the threshold in quiet: 17 bins a track meet each other."""
    hz = 250.0 * (F.col("bin") + 1)
    b = welch(spark, d).select("track", "bin", (10 * F.log10(F.col("p") + 1e-12) + 40).alias("level"), quiet_threshold_db(hz).alias("quiet"), bark(hz).alias("z"))
    few = b.groupBy("track").agg(F.collect_list(F.struct("bin", "level", "quiet", "z")).alias("bins"))
    spread = lambda a, o: o["level"] - 14.5 - F.when(o["z"] < a["z"], 10 * (a["z"] - o["z"])).otherwise(27 * (o["z"] - a["z"]))
    mask = lambda a: F.greatest(F.array_max(F.transform(F.filter("bins", lambda o: o["bin"] != a["bin"]), lambda o: spread(a, o))), a["quiet"])
    m = few.select("track", F.explode(F.transform("bins", lambda a: a["level"] - mask(a))).alias("margin"))
    return m.groupBy("track").agg(F.count_if(F.col("margin") > 0).alias("audible"), F.round(F.max("margin"), 4).alias("margin_db"))


@query(f"""WITH {v.PAIR}, n AS (SELECT track, max(ix) + 1 AS n FROM pair GROUP BY track), p AS (SELECT pair.*, (ix * 3) // n AS third FROM pair JOIN n USING (track)),
c AS (SELECT a.track, a.third, b.ix - a.ix AS lag, sum(a.src * b.out) AS s FROM p a JOIN p b ON a.track = b.track AND a.third = b.third AND b.ix BETWEEN a.ix - 3 AND a.ix + 3 GROUP BY ALL),
l AS (SELECT track, third, arg_min(lag, {{'a': -round(s, 6), 'b': abs(lag), 'c': lag}}) AS lag FROM c GROUP BY track, third)
SELECT track, (max(lag) - min(lag))::INTEGER AS drift, count(*) AS anchors FROM l GROUP BY track""")
def sync_drift(spark, d):
    """Lag of each third of a track by cross-correlation, and how far the three lie apart."""
    p = v.pair(spark, d)
    n = p.groupBy("track").agg((F.max("ix") + 1).alias("n"))
    thirds = p.join(n, "track").select((F.col("track") * 3 + F.floor(F.col("ix") * 3 / F.col("n"))).alias("track"), "ix", "src", "out")
    lags = transforms.correlation_lag(thirds, 3)
    return lags.groupBy(F.floor(F.col("track") / 3).alias("track")).agg((F.max("lag") - F.min("lag")).alias("drift"), F.count("*").alias("anchors"))


@query(f"""WITH {v.FRAME_LEVELS}, s AS (SELECT track, fix, greatest(0, level - coalesce(lag(level) OVER (PARTITION BY track ORDER BY fix), level)) AS rise FROM frame_levels),
w AS (SELECT *, max(rise) OVER (PARTITION BY track ORDER BY fix ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS top, avg(rise) OVER (PARTITION BY track ORDER BY fix ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS mean FROM s)
SELECT track, count_if(rise = top AND rise > 1.5 * mean) AS onsets, round(max(rise), 6) AS attack FROM w GROUP BY track""")
def transient_onsets(spark, d):
    """Rises of the level that are the largest within two frames and stand out over their surroundings."""
    s = layout.lagged(v.frame_levels(spark, d), ["track"], "fix", b=("level", 1))
    s = s.select("track", "fix", F.greatest(F.lit(0.0), F.col("level") - F.coalesce("b", "level")).alias("rise"))
    w = layout.in_block(["track"], "fix")
    h = layout.own(layout.with_halo(s, 4, 4, "fix").withColumns({"top": F.max("rise").over(w.rowsBetween(-2, 2)), "mean": F.avg("rise").over(w.rowsBetween(-4, 4))}))
    return h.groupBy("track").agg(F.count_if((F.col("rise") == F.col("top")) & (F.col("rise") > 1.5 * F.col("mean"))).alias("onsets"), F.round(F.max("rise"), 6).alias("attack"))


@query(f"""WITH {v.PAIR}, s AS (SELECT track, ix, out = lag(out) OVER (PARTITION BY track ORDER BY ix) AS held, abs(out - lag(out) OVER (PARTITION BY track ORDER BY ix)) > 150 AS jump FROM pair)
SELECT track, count_if(held) AS holds, count_if(jump) AS jumps FROM s GROUP BY track""")
def time_base(spark, d):
    """Samples that repeat the one before, and jumps, of the output."""
    s = layout.lagged(v.pair(spark, d), ["track"], b=("out", 1))
    return s.groupBy("track").agg(F.count_if(F.col("out") == F.col("b")).alias("holds"), F.count_if(F.abs(F.col("out") - F.col("b")) > 150).alias("jumps"))


# tuning loop

@query(f"""WITH {TOTALS}, p AS (SELECT a.tape, a.candidate AS a, b.candidate AS b, 1 / (1 + exp(b.total - a.total)) AS p, abs(a.band - b.band) / (a.band + b.band + 1e-9) AS disagreement
  FROM totals a JOIN totals b ON a.tape = b.tape AND a.candidate < b.candidate)
SELECT tape, a, b, round(abs(p - 0.5) * (1 - disagreement), 6) AS priority FROM p QUALIFY row_number() OVER (ORDER BY round(abs(p - 0.5) * (1 - disagreement), 6), tape, a, b) <= 10""")
def active_learning_pairs(spark, d):
    """The ten pairs of candidates that are hardest to call and most agreed upon."""
    t = totals(spark, d)
    a, b = t.alias("a"), t.alias("b")
    j = a.join(b, (F.col("a.tape") == F.col("b.tape")) & (F.col("a.candidate") < F.col("b.candidate")))
    p = 1 / (1 + F.exp(F.col("b.total") - F.col("a.total")))
    disagreement = F.abs(F.col("a.band") - F.col("b.band")) / (F.col("a.band") + F.col("b.band") + 1e-9)
    x = j.select("a.tape", F.col("a.candidate").alias("a"), F.col("b.candidate").alias("b"), F.round(F.abs(p - 0.5) * (1 - disagreement), 6).alias("priority"))
    return x.orderBy("priority", "tape", "a", "b").limit(10)


@query(f"""WITH {FLAT}, cheap AS (SELECT tape, candidate, sum(dist) AS cheap FROM filled WHERE family = 'level' GROUP BY tape, candidate), best AS (SELECT tape, min(cheap) AS best FROM cheap GROUP BY tape),
c AS (SELECT tape, candidate FROM cheap JOIN best USING (tape) WHERE cheap <= best + 1.0)
SELECT f.tape, f.candidate, round(sum(f.dist), 9) AS total FROM filled f JOIN c USING (tape, candidate) GROUP BY f.tape, f.candidate""")
def two_stage_scoring(spark, d):
    """Cheap readings first; only contenders near the best of their tape are scored on all."""
    f = filled(spark, d)
    cheap = f.where("family = 'level'").groupBy("tape", "candidate").agg(F.sum("dist").alias("cheap"))
    best = cheap.groupBy("tape").agg(F.min("cheap").alias("best"))
    near = cheap.join(best, "tape").where(F.col("cheap") <= F.col("best") + 1.0)
    return f.join(near, ["tape", "candidate"], "left_semi").groupBy("tape", "candidate").agg(F.round(F.sum("dist"), 9).alias("total"))


@query(f"""WITH {TOTALS}, best AS (SELECT arg_min(candidate, {{'m': round(m, 9), 'c': candidate}}) AS candidate FROM (SELECT candidate, avg(total) AS m FROM totals GROUP BY candidate)),
i AS (SELECT DISTINCT p_brand || p_type AS grid, p_size AS size FROM part), moves AS (SELECT grid, size + step AS size, step FROM i, (VALUES (-1), (1)) s(step) WHERE size + step BETWEEN 1 AND 50)
SELECT candidate, grid, size, count(*) AS n FROM best, moves WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.grid = moves.grid AND i.size = moves.size) GROUP BY ALL""")
def neighbour_proposals(spark, d):
    """Neighbours on each grid, one step either way, of settings in use that are not in use themselves, for the leader."""
    t = totals(spark, d).groupBy("candidate").agg(F.avg("total").alias("m")).agg(F.min_by("candidate", F.struct(F.round("m", 9), "candidate")).alias("candidate"))
    leader = t.head()["candidate"]
    i = v.table(spark, d, "part").select(F.concat("p_brand", "p_type").alias("grid"), F.col("p_size").alias("size")).distinct()
    moves = i.withColumn("size", F.explode(F.array(F.col("size") - 1, F.col("size") + 1))).where(F.col("size").between(1, 50))
    return moves.join(i, ["grid", "size"], "left_anti").groupBy(F.lit(leader).alias("candidate"), "grid", "size").agg(F.count("*").alias("n"))


@query(f"""WITH {TOTALS}, r AS (SELECT tape, candidate, rank() OVER (PARTITION BY tape ORDER BY round(total, 3)) AS place FROM totals), i AS (SELECT tape, total AS theirs FROM totals WHERE candidate = '5-LOW')
SELECT t.candidate, round(avg(r.place), 6) AS mean_rank, count_if(t.total < i.theirs - 0.05) AS wins, count_if(t.total > i.theirs + 0.05) AS losses,
  CASE WHEN count_if(t.total > i.theirs + 0.05) > 0.5 * count(*) THEN 'vetoed' WHEN count_if(abs(t.total - i.theirs) > 0.05) = 0 THEN 'unmoved' ELSE 'open' END AS verdict
FROM totals t JOIN r USING (tape, candidate) JOIN i USING (tape) WHERE t.candidate <> '5-LOW' GROUP BY t.candidate""")
def judge(spark, d):
    """Mean rank, wins and losses against the incumbent, and a verdict for each candidate."""
    t = totals(spark, d)
    r = t.withColumn("place", F.rank().over(Window.partitionBy("tape").orderBy(F.round("total", 3))))
    i = t.where("candidate = '5-LOW'").select("tape", F.col("total").alias("theirs"))
    gap = F.col("total") - F.col("theirs")
    g = r.join(i, "tape").where("candidate <> '5-LOW'").groupBy("candidate").agg(F.round(F.avg("place"), 6).alias("mean_rank"), F.count_if(gap < -0.05).alias("wins"), F.count_if(gap > 0.05).alias("losses"), F.count_if(F.abs(gap) > 0.05).alias("moved"), F.count("*").alias("n"))
    verdict = F.when(F.col("losses") > 0.5 * F.col("n"), "vetoed").when(F.col("moved") == 0, "unmoved").otherwise("open")
    return g.select("candidate", "mean_rank", "wins", "losses", verdict.alias("verdict"))


@query(f"""WITH {FLAT}, s AS (SELECT tape, candidate, sum(dist) AS score FROM filled GROUP BY tape, candidate), h AS (SELECT tape, candidate, count_if(median > 13.5) AS hard FROM summary WHERE metric = 'noise' AND side = 'delta' GROUP BY tape, candidate)
SELECT tape, candidate, hard, row_number() OVER (PARTITION BY tape ORDER BY hard, round(score, 6), candidate)::INTEGER AS place FROM s JOIN h USING (tape, candidate)""")
def ordering_check(spark, d):
    """Candidates by hard failures first and summed distance then."""
    from sigloom.plans.scoring import summary

    s = filled(spark, d).groupBy("tape", "candidate").agg(F.sum("dist").alias("score"))
    h = summary(spark, d).where("metric = 'noise' AND side = 'delta'").groupBy("tape", "candidate").agg(F.count_if(F.col("median") > 13.5).alias("hard"))
    w = Window.partitionBy("tape").orderBy("hard", F.round("score", 6), "candidate")
    return s.join(h, ["tape", "candidate"]).select("tape", "candidate", "hard", F.row_number().over(w).alias("place"))


@query(f"""WITH {v.POWER64}, a AS (SELECT track, p, list_position(p[2:32], list_max(p[2:32])) + 1 AS k FROM power64),
f AS (SELECT track, (k - 1) + 0.5 * (sqrt(p[k - 1]) - sqrt(p[k + 1])) / (sqrt(p[k - 1]) - 2 * sqrt(p[k]) + sqrt(p[k + 1]) - 1e-12) AS hz, p[k] / (list_avg(p[2:32]) + 1e-12) AS prominence FROM a)
SELECT track, count(*) AS frames, round(stddev_pop(hz) / avg(hz), 7) AS deviation, stddev_pop(hz) / avg(hz) > 0.003 AS drifts FROM f WHERE prominence > 4 GROUP BY track HAVING count(*) >= 8""")
def speed_drift(spark, d):
    """Relative deviation of the strongest line's refined position over frames where it is prominent."""
    inner = F.slice("p", 2, 31)
    a = spectra(spark, d).withColumn("k", (F.array_position(inner, F.array_max(inner)) + 1).cast("int"))
    at = lambda i: F.sqrt(F.element_at("p", F.col("k") + i))
    mean = F.aggregate(inner, F.lit(0.0), lambda s, x: s + x) / 31
    hz = (F.col("k") - 1) + 0.5 * (at(-1) - at(1)) / (at(-1) - 2 * at(0) + at(1) - 1e-12)
    f = a.select("track", hz.alias("hz"), (F.element_at("p", F.col("k")) / (mean + 1e-12)).alias("prominence")).where(F.col("prominence") > 4)
    g = f.groupBy("track").agg(F.count("*").alias("frames"), (F.stddev_pop("hz") / F.avg("hz")).alias("d")).where(F.col("frames") >= 8)
    return g.select("track", "frames", F.round("d", 7).alias("deviation"), (F.col("d") > 0.003).alias("drifts"))


@query(f"""WITH {v.POWER64}, e AS (SELECT track, unnest(range(1, 32)) AS bin, unnest(p[2:32]) AS p, list_avg(p[2:32]) AS mean FROM power64)
SELECT track, bin::INTEGER AS bin, round(avg((p > 2 * mean)::INTEGER), 6) AS persistence FROM e GROUP BY track, bin HAVING avg((p > 2 * mean)::INTEGER) >= 0.2""")
def persistent_tones(spark, d):
    """Bins that stand above twice their frame's mean in a fifth of the frames or more."""
    mean = F.aggregate(F.slice("p", 2, 31), F.lit(0.0), lambda s, x: s + x) / 31
    e = spectra(spark, d).select("track", mean.alias("mean"), F.posexplode(F.slice("p", 2, 31)).alias("bin", "p"))
    g = e.groupBy("track", (F.col("bin") + 1).alias("bin")).agg(F.avg((F.col("p") > 2 * F.col("mean")).cast("int")).alias("share"))
    return g.where(F.col("share") >= 0.2).select("track", "bin", F.round("share", 6).alias("persistence"))


@query(f"""WITH {WELCH.replace("ps AS (SELECT track,", "ps AS (SELECT track, fix,")}, fe AS (SELECT track, fix, sum(p) AS e FROM ps GROUP BY track, fix),
q AS (SELECT track, quantile_cont(e, 0.2) AS lo, quantile_cont(e, 0.7) AS hi FROM fe GROUP BY track),
b AS (SELECT track, bin, ln(avg(p) FILTER (WHERE e <= lo) + 1e-12) AS quiet, ln(avg(p) FILTER (WHERE e >= hi) + 1e-12) AS loud FROM ps JOIN fe USING (track, fix) JOIN q USING (track) GROUP BY track, bin)
SELECT track, round(corr(quiet, loud), 6) AS similarity FROM b GROUP BY track""")
def probe_similarity(spark, d):
    """Correlation of the logarithmic mean spectra of a track's quietest and loudest frames."""
    f = layout.cut(frame_powers(v.signal_long(spark, d)).select("track", "p", F.aggregate("p", F.lit(0.0), lambda a, b: a + b).alias("e")))
    q = layout.quantiles(f, ["track"], "e", lo=0.2, hi=0.7)
    mean = lambda c, k: F.avg(F.when(c, F.col("p")[k]))
    per = f.join(q, "track").groupBy("track").agg(*[mean(F.col("e") <= F.col("lo"), k).alias(f"q{k}") for k in range(17)], *[mean(F.col("e") >= F.col("hi"), k).alias(f"l{k}") for k in range(17)])
    log = lambda c: F.log(F.col(c) + 1e-12)
    m = per.select("track", F.explode(F.array(*[F.struct(log(f"q{k}").alias("quiet"), log(f"l{k}").alias("loud")) for k in range(17)])).alias("b"))
    return m.groupBy("track").agg(F.round(F.corr("b.quiet", "b.loud"), 6).alias("similarity"))
