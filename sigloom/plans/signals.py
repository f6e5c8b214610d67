"""Queries on samples and frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloom.functions.levels import amplitude_db, power_spectrum
from sigloom.operators import frames as fr
from sigloom.operators import layout
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


MASKED = v.FRAME_PAIRS + """, bounds AS (
  SELECT track, quantile_cont(ls, 0.2) AS p_lo, quantile_cont(ls, 0.7) AS p_hi FROM frame_pairs GROUP BY track
  HAVING count(*) >= 8 AND 20 * log10(quantile_cont(ls, 0.7) + 1e-12) - 20 * log10(quantile_cont(ls, 0.2) + 1e-12) >= 3.0),
masked AS (SELECT f.*, p_lo, ls <= p_lo AS quiet, ls >= p_hi AS loud FROM frame_pairs f JOIN bounds USING (track))"""
TRADE = MASKED + """, energies AS (
  SELECT track, sqrt(avg(ls * ls) FILTER (WHERE quiet)) AS sq, sqrt(avg(lo * lo) FILTER (WHERE quiet)) AS oq,
         sqrt(avg(ls * ls) FILTER (WHERE loud)) AS sl, sqrt(avg(lo * lo) FILTER (WHERE loud)) AS ol FROM masked GROUP BY track),
trade AS (
  SELECT track, round(20 * log10((sq + 1e-12) / (oq * ((sl + 1e-12) / (ol + 1e-12)) + 1e-12)), 3) AS removed_db,
         round(abs(20 * log10((ol + 1e-12) / (sl + 1e-12))), 3) AS deviation_db FROM energies)"""


def masked(spark, d):
    return fr.quiet_loud(v.frame_pairs(spark, d), "ls")


@query(f"WITH {v.FRAME_PAIRS} SELECT track, fix, round(ls, 6) AS level FROM frame_pairs")
def frame_rms(spark, d):
    return v.frame_pairs(spark, d).select("track", "fix", F.round("ls", 6).alias("level"))


@query(f"WITH {MASKED} SELECT track, count(*) AS n, count_if(quiet) AS n_quiet, count_if(loud) AS n_loud FROM masked GROUP BY track")
def quiet_loud_masks(spark, d):
    return masked(spark, d).groupBy("track").agg(F.count("*").alias("n"), F.count_if("quiet").alias("n_quiet"), F.count_if("loud").alias("n_loud"))


@query(f"WITH {TRADE} SELECT * FROM trade")
def trade_readings(spark, d):
    return fr.trade(masked(spark, d))


@query(f"""WITH {TRADE}, melted AS (
  SELECT 'removed' AS metric, removed_db AS v FROM trade UNION ALL SELECT 'deviation', deviation_db FROM trade),
agg AS (SELECT metric, quantile_cont(v, 0.5) AS median, quantile_cont(v, CASE WHEN metric = 'removed' THEN 0.1 ELSE 0.9 END) AS tail, count(*) AS n
  FROM (SELECT * FROM melted WHERE metric = 'removed') GROUP BY metric
  UNION ALL SELECT metric, quantile_cont(v, 0.5), quantile_cont(v, 0.9), count(*) FROM melted WHERE metric = 'deviation' GROUP BY metric)
SELECT metric, round(median, 4) AS median, round(tail, 4) AS tail, n,
       CASE WHEN metric = 'removed' THEN CASE WHEN median >= 1.0 THEN 'passed' ELSE 'failed' END
            ELSE CASE WHEN tail <= 6.0 THEN 'passed' ELSE 'failed' END END AS status FROM agg""".replace("quantile_cont(v, CASE WHEN metric = 'removed' THEN 0.1 ELSE 0.9 END)", "quantile_cont(v, 0.1)"))
def trade_gates(spark, d):
    """The flagship: levels, masks, trade, routed summary and gate of all tracks."""
    t = fr.trade(masked(spark, d))
    melted = t.select(F.explode(F.array(F.struct(F.lit("removed").alias("metric"), F.col("removed_db").alias("v")), F.struct(F.lit("deviation").alias("metric"), F.col("deviation_db").alias("v")))).alias("m")).select("m.*")
    q = layout.quantiles(melted, ["metric"], "v", p10=0.1, median=0.5, p90=0.9).join(melted.groupBy("metric").agg(F.count("*").alias("n")), "metric")
    better = F.col("metric") == "removed"  # a higher median is better; of deviations the lower tail
    tail = F.when(better, F.col("p10")).otherwise(F.col("p90"))
    good = F.when(better, F.col("median") >= 1.0).otherwise(tail <= 6.0)
    return q.select("metric", F.round("median", 4).alias("median"), F.round(tail, 4).alias("tail"), "n", F.when(good, "passed").otherwise("failed").alias("status"))


@query(f"WITH {MASKED} SELECT track, round(20 * log10((avg(lo) + 1e-12) / (avg(ls) + 1e-12)), 4) AS residual_db FROM masked WHERE quiet GROUP BY track")
def residual_noise(spark, d):
    return fr.residual_noise(masked(spark, d))


@query(f"""WITH {v.FRAME_PAIRS}, q AS (SELECT track, quantile_cont(ls, 0.15) AS p FROM frame_pairs GROUP BY track)
SELECT track, round(stddev_pop(20 * log10(lo + 1e-9)), 4) AS pumping_db FROM frame_pairs JOIN q USING (track) WHERE ls <= p GROUP BY track HAVING count(*) >= 2""")
def pause_pumping(spark, d):
    return fr.pumping(v.frame_pairs(spark, d))


@query(f"WITH {MASKED} SELECT track, round(quantile_cont(20 * log10((ls + 1e-12) / (lo + 1e-12)), 0.5), 4) AS drop_db FROM masked WHERE quiet GROUP BY track")
def median_drop(spark, d):
    return fr.median_drop(masked(spark, d))


@query(f"""WITH {v.FRAME_LEVELS}, f AS (
  SELECT track, round_even(least(greatest(20 * log10(quantile_cont(level, 0.1) + 1e-6), -80), -20), 1)::DOUBLE AS floor_db FROM frame_levels GROUP BY track)
SELECT track, floor_db, CASE WHEN floor_db < -60 THEN 8.0 WHEN floor_db < -45 THEN 11.0 WHEN floor_db < -35 THEN 13.5 ELSE 16.0 END::DOUBLE AS reduction FROM f""")
def noise_floor_reduction(spark, d):
    return fr.noise_floor(v.frame_levels(spark, d))


@query(f"""WITH {v.FRAME_LEVELS}, f AS (
  SELECT track, least(greatest(20 * log10(quantile_cont(level, 0.1) + 1e-6), -80), -20) AS floor_db FROM frame_levels GROUP BY track),
r AS (SELECT track, 20 * log10(sqrt(avg(x * x)) + 1e-12) AS rms_db FROM signal_long GROUP BY track)
SELECT track, round(rms_db - floor_db, 4) AS margin_db FROM f JOIN r USING (track)""")
def snr_margin(spark, d):
    q = layout.quantiles(v.frame_levels(spark, d), ["track"], "level", p=0.1).select("track", F.least(F.greatest(20 * F.log10(F.col("p") + 1e-6), F.lit(-80.0)), F.lit(-20.0)).alias("floor_db"))
    r = v.signal_long(spark, d).groupBy("track").agg(amplitude_db(F.sqrt(F.avg(F.col("x") * F.col("x")))).alias("rms_db"))
    return q.join(r, "track").select("track", F.round(F.col("rms_db") - F.col("floor_db"), 4).alias("margin_db"))


@query(f"""WITH {v.LONG}, d1 AS (SELECT track, ix, abs(x - lag(x) OVER w) AS d FROM signal_long WINDOW w AS (PARTITION BY track ORDER BY ix)),
d2 AS (SELECT track, abs(d - lag(d) OVER w) AS d2 FROM d1 WINDOW w AS (PARTITION BY track ORDER BY ix)),
m AS (SELECT track, avg(d2) AS m FROM d2 GROUP BY track)
SELECT track, count_if(d2 > 10 * (m + 1e-9)) AS hits, round(count_if(d2 > 10 * (m + 1e-9)) / count(d2), 6) AS density,
       count_if(d2 > 10 * (m + 1e-9)) / count(d2) > 1e-4 AS has_clicks FROM d2 JOIN m USING (track) WHERE d2 IS NOT NULL GROUP BY track""")
def click_predicate(spark, d):
    s = layout.lagged(v.signal_long(spark, d), ["track"], a=("x", 1), b=("x", 2))
    s = s.select("track", F.abs(F.abs(F.col("x") - F.col("a")) - F.abs(F.col("a") - F.col("b"))).alias("d2")).where(F.col("d2").isNotNull())
    m = s.groupBy("track").agg(F.avg("d2").alias("m"))
    g = s.join(m, "track").groupBy("track").agg(F.count_if(F.col("d2") > 10 * (F.col("m") + 1e-9)).alias("hits"), F.count("*").alias("n"))
    return g.select("track", "hits", F.round(F.col("hits") / F.col("n"), 6).alias("density"), (F.col("hits") / F.col("n") > 1e-4).alias("has_clicks"))


@query(f"""WITH {v.LONG}, c AS (SELECT track, channel, count_if(abs(x) >= 0.985) AS n FROM signal_long GROUP BY track, channel)
SELECT track, sum(n)::BIGINT AS clipped, sum(n) >= 20 AS has_clipping, max(n) >= 20 AS has_clipping_any_channel FROM c GROUP BY track""")
def clip_predicate(spark, d):
    c = v.signal_long(spark, d).groupBy("track", "channel").agg(F.count_if(F.abs("x") >= 0.985).alias("n"))
    return c.groupBy("track").agg(F.sum("n").alias("clipped"), (F.sum("n") >= 20).alias("has_clipping"), (F.max("n") >= 20).alias("has_clipping_any_channel"))


@query(f"WITH {v.LONG} SELECT track, round(avg(x), 6) AS offset_, abs(avg(x)) >= 0.003 AS has_offset FROM signal_long WHERE ix < 32768 GROUP BY track")
def dc_offset(spark, d):
    m = v.signal_long(spark, d).where(F.col("ix") < 32768).groupBy("track").agg(F.avg("x").alias("m"))
    return m.select("track", F.round("m", 6).alias("offset_"), (F.abs("m") >= 0.003).alias("has_offset"))


@query(f"""WITH {v.LONG}, b AS (
  SELECT track, 20 * log10(sqrt(avg(x * x) FILTER (WHERE channel = 0)) / sqrt(avg(x * x) FILTER (WHERE channel = 1))) AS b FROM signal_long WHERE ix < 32768 GROUP BY track)
SELECT track, CASE WHEN abs(b) < 1 THEN 0.0 ELSE round(b, 4) END::DOUBLE AS balance_db,
       CASE WHEN abs(b) <= 0.5 THEN 'none' WHEN abs(b) <= 12 THEN 'level' WHEN abs(b) > 25 THEN 'mirror' ELSE 'keep' END AS repair FROM b""")
def balance(spark, d):
    power = lambda c: F.sqrt(F.avg(F.when(F.col("channel") == c, F.col("x") * F.col("x"))))
    b = v.signal_long(spark, d).where(F.col("ix") < 32768).groupBy("track").agg((20 * F.log10(power(0) / power(1))).alias("b"))
    a = F.abs("b")
    repair = F.when(a <= 0.5, "none").when(a <= 12, "level").when(a > 25, "mirror").otherwise("keep")
    return b.select("track", F.when(a < 1, 0.0).otherwise(F.round("b", 4)).alias("balance_db"), repair.alias("repair"))


@query("""SELECT l_suppkey AS track, round(coalesce(corr(l_quantity, l_extendedprice), 0), 6) AS r,
  coalesce(corr(l_quantity, l_extendedprice), 0) <= -0.3 AS inverted FROM lineitem GROUP BY l_suppkey""")
def channel_correlation(spark, d):
    r = F.coalesce(F.corr("l_quantity", "l_extendedprice"), F.lit(0.0))
    return v.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("track")).agg(F.round(r, 6).alias("r"), (r <= -0.3).alias("inverted"))


@query("SELECT event_type AS track, round(10 * log10(avg(pow(10, value / 100))), 6) AS mean_db FROM events GROUP BY event_type")
def power_mean(spark, d):
    return v.table(spark, d, "events").groupBy(F.col("event_type").alias("track")).agg(F.round(10 * F.log10(F.avg(F.pow(F.lit(10.0), F.col("value") / 100))), 6).alias("mean_db"))


@query(f"""WITH {v.LONG}, s AS (SELECT track, ix, x, ix < 5 OR coalesce(x = lag(x) OVER w, false) AS held, x = 0 AS mute FROM signal_long WINDOW w AS (PARTITION BY track ORDER BY ix))
SELECT track, ix // 64 AS fix, NOT bool_and(mute) AND count_if(held) < 0.5 * count(*) AS live FROM s GROUP BY track, ix // 64""")
def live_frames(spark, d):
    s = layout.lagged(v.signal_long(spark, d), ["track"], a=("x", 1))
    held = (F.col("ix") < 5) | F.coalesce(F.col("x") == F.col("a"), F.lit(False))
    g = s.groupBy("track", F.floor(F.col("ix") / 64).alias("fix"))
    return g.agg((~F.bool_and(F.col("x") == 0) & (F.count_if(held) < 0.5 * F.count("*"))).alias("live"))


# spectra of short frames

BANDS = v.POWER64 + """, shares AS (
  SELECT track, frame_ix, p, list_sum(p[2:]) AS total, list_sum(p[4:11]) AS mid, list_sum(p[17:]) AS high FROM power64)"""


def spectra(spark, d):
    return v.frames64(spark, d).withColumn("p", power_spectrum(F.col("x"), 64))


def total(p: str, first: int, last: int):
    """Sum of bins ``first`` to ``last``."""
    return F.aggregate(F.slice(p, first + 1, last - first + 1), F.lit(0.0), lambda s, x: s + x)


@query(f"""WITH {BANDS} SELECT track, frame_ix, round(least(1.0, 1.6 * mid / (total + 1e-12)), 2) AS speech,
  round(least(1.0, 4 * high / (total + 1e-12) / 4), 2) AS ambient FROM shares""")
def band_ratios(spark, d):
    s = spectra(spark, d).select("track", "frame_ix", total("p", 1, 32).alias("total"), total("p", 3, 10).alias("mid"), total("p", 16, 32).alias("high"))
    return s.select("track", "frame_ix", F.round(F.least(F.lit(1.0), 1.6 * F.col("mid") / (F.col("total") + 1e-12)), 2).alias("speech"), F.round(F.least(F.lit(1.0), F.col("high") / (F.col("total") + 1e-12)), 2).alias("ambient"))


@query(f"""WITH {v.POWER64} SELECT track, frame_ix, round(list_sum(list_sort(list_transform(p, lambda v: sqrt(v)), 'DESC')[1:5]) / (list_sum(list_transform(p, lambda v: sqrt(v))) + 1e-12), 6) AS share FROM power64""")
def topk_share(spark, d):
    m = F.transform("p", lambda x: F.sqrt(x))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return spectra(spark, d).select("track", "frame_ix", F.round(add(F.slice(F.sort_array(m, False), 1, 5)) / (add(m) + 1e-12), 6).alias("share"))


@query(f"""WITH {v.POWER64}, f AS (SELECT track, exp(list_avg(list_transform(p[3:], lambda v: ln(v + 1e-12)))) / (list_avg(p[3:]) + 1e-12) AS flat FROM power64)
SELECT track, round(quantile_cont(flat, 0.5), 6) AS flatness FROM f GROUP BY track""")
def spectral_flatness(spark, d):
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    p = F.slice("p", 3, 31)
    f = spectra(spark, d).select("track", (F.exp(add(F.transform(p, lambda x: F.log(x + 1e-12))) / 31) / (add(p) / 31 + 1e-12)).alias("flat"))
    return layout.quantiles(f, ["track"], "flat", m=0.5).select("track", F.round("m", 6).alias("flatness"))


LKR = v.POWER64 + """, e AS (SELECT track, unnest(range(0, 33)) AS bin, unnest(p) AS p, unnest(list_transform(p, lambda v: CASE WHEN v < 0.2 THEN v * 0.1 ELSE v END)) AS q FROM power64),
k AS (SELECT track, bin, kurtosis_pop(p) + 3 AS ks, kurtosis_pop(q) + 3 AS ko FROM e GROUP BY track, bin)"""


@query(f"WITH {LKR} SELECT track, round(quantile_cont(ln(ko) - ln(ks), 0.5), 6) AS lkr FROM k GROUP BY track")
def kurtosis_ratio(spark, d):
    e = spectra(spark, d).select("track", F.posexplode("p").alias("bin", "p")).withColumn("q", F.when(F.col("p") < 0.2, F.col("p") * 0.1).otherwise(F.col("p")))
    k = e.groupBy("track", "bin").agg((F.kurtosis("p") + 3).alias("ks"), (F.kurtosis("q") + 3).alias("ko"))
    return layout.quantiles(k.select("track", (F.log("ko") - F.log("ks")).alias("r")), ["track"], "r", m=0.5).select("track", F.round("m", 6).alias("lkr"))


@query(f"""WITH {v.POWER64}, a AS (SELECT track, frame_ix, p, list_position(p[2:32], list_max(p[2:32])) + 1 AS k FROM power64)
SELECT track, frame_ix, (k - 1)::INTEGER AS bin, round(0.5 * (sqrt(p[k - 1]) - sqrt(p[k + 1])) / (sqrt(p[k - 1]) - 2 * sqrt(p[k]) + sqrt(p[k + 1]) - 1e-12), 6) AS off FROM a""")
def peak_refine(spark, d):
    inner = F.slice("p", 2, 31)
    a = spectra(spark, d).withColumn("k", (F.array_position(inner, F.array_max(inner)) + 1).cast("int"))
    at = lambda i: F.sqrt(F.element_at("p", F.col("k") + i))
    return a.select("track", "frame_ix", (F.col("k") - 1).alias("bin"), F.round(0.5 * (at(-1) - at(1)) / (at(-1) - 2 * at(0) + at(1) - 1e-12), 6).alias("off"))


@query(f"""WITH {v.POWER64}, n AS (SELECT track, row_number() OVER (PARTITION BY track ORDER BY frame_ix) - 1 AS ix, unnest(range(0, 33)) AS bin, unnest(p) AS p FROM power64),
k AS (SELECT track, ix, bin, (p >= 1.5)::INTEGER AS peak FROM n),
h AS (SELECT *, min(peak) OVER w AS held, count(*) OVER w AS ahead FROM k WINDOW w AS (PARTITION BY track, bin ORDER BY ix ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING))
SELECT track, count_if(peak = 1 AND held = 1 AND ahead = 2) AS kept, count_if(peak = 1 AND ahead = 2) AS peaks FROM h GROUP BY track""")
def persistence_next(spark, d):
    n = layout.numbered(spectra(spark, d).select("track", "frame_ix", "p"), ["track"], ["frame_ix"], F.floor(F.col("frame_ix") / 1024))
    k = n.select("track", "ix", F.posexplode("p").alias("bin", "p")).withColumn("peak", (F.col("p") >= 1.5).cast("int"))
    h = layout.lagged(k, ["track", "bin"], a=("peak", -1), b=("peak", -2)).where((F.col("peak") == 1))
    whole = F.col("b").isNotNull()
    per = h.groupBy("track").agg(F.count_if(whole & (F.least("a", "b") == 1)).alias("kept"), F.count_if(whole).alias("peaks"))
    return k.select("track").distinct().join(per, "track", "left").select("track", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("peaks", F.lit(0)).alias("peaks"))


@query(f"""WITH {v.POWER64}, n AS (SELECT track, row_number() OVER (PARTITION BY track ORDER BY frame_ix) - 1 AS ix, unnest(range(0, 33)) AS bin, unnest(p) AS p FROM power64),
m AS (SELECT track, bin, avg(p) OVER w AS mean, count(*) OVER w AS n FROM n WINDOW w AS (PARTITION BY track, bin ORDER BY ix ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
h AS (SELECT track, bin, least(greatest(floor((10 * log10(mean + 1e-16) + 160) * 10), 0), 2399)::INTEGER AS cell, count(*) AS c FROM m WHERE n = 4 GROUP BY ALL),
s AS (SELECT *, sum(c) OVER (PARTITION BY track, bin ORDER BY cell) AS upto, sum(c) OVER (PARTITION BY track, bin) AS total FROM h)
SELECT track, bin::INTEGER AS bin, round(min(cell) / 10 - 160 + 0.05 + 0.62, 4) AS print_db FROM s WHERE upto >= 0.05 * total GROUP BY track, bin""")
def quantile_print(spark, d):
    """Noise print: 5 % quantile of a four-frame moving mean per bin, from a histogram of 0.1 dB cells that merges exactly."""
    n = layout.numbered(spectra(spark, d).select("track", "frame_ix", "p"), ["track"], ["frame_ix"], F.floor(F.col("frame_ix") / 1024))
    k = n.select("track", "ix", F.posexplode("p").alias("bin", "p"))
    m = layout.lagged(k, ["track", "bin"], a=("p", 1), b=("p", 2), c=("p", 3)).where(F.col("c").isNotNull())
    mean = (F.col("c") + F.col("b") + F.col("a") + F.col("p")) / 4
    cell = F.least(F.greatest(F.floor((10 * F.log10(mean + 1e-16) + 160) * 10), F.lit(0)), F.lit(2399)).cast("int")
    h = m.groupBy("track", "bin", cell.alias("cell")).agg(F.count("*").alias("c_"))  # at most 2,400 cells a bin
    from pyspark.sql import Window

    w = Window.partitionBy("track", "bin")
    s = h.withColumns({"upto": F.sum("c_").over(w.orderBy("cell")), "total": F.sum("c_").over(w)}).where(F.col("upto") >= 0.05 * F.col("total"))
    return s.groupBy("track", "bin").agg(F.round(F.min("cell") / 10 - 160 + 0.05 + 0.62, 4).alias("print_db"))
