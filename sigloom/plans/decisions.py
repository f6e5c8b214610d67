"""Queries of decisions: rollups of variants, gates of each tape, protected gates, vetoes, refused settings, rewards under all of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloom.operators import decisions, filters, layout, scoring
from sigloom.plans import programme
from sigloom.plans import scoring as base
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


INCUMBENT = "5-LOW"


@query(f"""WITH {base.DELTAS} SELECT candidate, metric AS reading, grouping(tape) = 1 AS whole, tape, round(quantile_cont(delta, 0.5), 9) AS median,
  CASE WHEN grouping(tape) = 1 THEN round(quantile_cont(delta, 0.1), 9) END AS p10, count(*) AS n FROM deltas GROUP BY GROUPING SETS ((candidate, metric), (candidate, metric, tape))""")
def variant_rollup(spark, d):
    """Median and bad tail of each candidate's readings over all windows, and its median on each tape."""
    x = scoring.deltas(v.readings(spark, d)).select("tape", "candidate", F.col("metric").alias("reading"), F.col("delta").alias("value"))
    return decisions.rollup(x).select("candidate", "reading", "whole", "tape", F.round("median", 9).alias("median"), F.round("p10", 9).alias("p10"), "n")


@query(f"""WITH {base.DELTAS}, f AS (SELECT candidate, count(DISTINCT CASE WHEN delta > 30 THEN win END) AS failed FROM deltas WHERE metric = 'noise' GROUP BY candidate)
SELECT candidate, failed, b.baseline, failed > greatest(2, b.baseline) AS vetoed FROM f, (SELECT coalesce(max(failed), 0) AS baseline FROM f WHERE candidate = '{INCUMBENT}') b""")
def excused_variants(spark, d):
    """Candidates that fail on more windows than two and than the incumbent."""
    x = scoring.deltas(v.readings(spark, d)).where("metric = 'noise'")
    return decisions.excused(x.select("candidate", F.col("win").alias("excerpt"), (F.col("delta") > 30).alias("failed")), INCUMBENT, 2)


#: gate, metric, side, stat, op, threshold (a number or relative to the tape's floor), severity
FLOOR_GATES = [("tone_floor", "tone", "out", "median", ">=", "floor+2.5", "hard"), ("tone_tail", "tone", "out", "tail", ">=", "floor", "soft"), ("noise_median", "noise", "delta", "median", "<=", "13.2", "hard"), ("drop_floor", "drop", "out", "median", "abs<=", "floor-2.75", "soft"), ("ghost", "ghost", "out", "median", ">=", "floor", "hard")]


@query(f"""WITH {base.SUMMARY}, gates(gate, metric, side, stat, op, t, severity) AS (VALUES {base.values(FLOOR_GATES)}),
floors AS (SELECT tape, quantile_cont(src, 0.5) AS floor FROM readings WHERE metric = 'tone' AND tape <> 5 GROUP BY tape),
j AS (SELECT c.tape, c.candidate, g.gate, g.severity, g.op, CASE g.stat WHEN 'tail' THEN s.tail ELSE s.median END AS value,
    CASE WHEN t LIKE 'floor%' THEN floor + coalesce(try_cast(nullif(substr(t, 6), '') AS DOUBLE), 0) ELSE try_cast(t AS DOUBLE) END AS threshold
  FROM (SELECT DISTINCT tape, candidate FROM summary) c CROSS JOIN gates g LEFT JOIN floors f ON f.tape = c.tape
  LEFT JOIN summary s ON s.tape = c.tape AND s.candidate = c.candidate AND s.metric = g.metric AND s.side = g.side)
SELECT tape, candidate, gate, severity, round(value, 9) AS value, round(threshold, 9) AS threshold, CASE WHEN value IS NULL OR threshold IS NULL THEN 'skipped'
  WHEN CASE op WHEN '<=' THEN value <= threshold WHEN '>=' THEN value >= threshold ELSE abs(value) <= threshold END THEN 'passed' ELSE 'failed' END AS status FROM j""")
def floor_gates(spark, d):
    """Verdicts of gates that are relative to the floor of each tape; one tape has none."""
    x = layout.cut(v.readings(spark, d))
    floors = layout.quantiles(x.where("metric = 'tone' AND tape <> 5"), ["tape"], "src", floor=0.5)
    s = layout.cut(scoring.summarise(scoring.deltas(x), base.specs(spark)))
    gates = spark.createDataFrame(FLOOR_GATES, "gate string, metric string, side string, stat string, op string, threshold string, severity string")
    return decisions.floor_verdicts(s, gates, floors).withColumns({c: F.round(c, 9) for c in ("value", "threshold")})


#: gate, metric, op, threshold, severity, n_verdicts, source
FRESH = [
    ("noise_tail", None, None, 20.0, "soft", 4, "known ordering"), ("tone_median", None, None, 3.0, None, 0, "floor"), ("tone_level", None, None, 9.0, "hard", 2, "known ordering"), ("drop_size", None, None, 1.0, "hard", 3, "by hand"),
    ("gone", "noise", "<=", 1.0, "hard", 0, None), ("added", "noise", "<=", 14.0, "soft", 1, "known good bound"),
]
FIXED, DISPLAY, RETIRED = ("drop_size",), ("noise_tail", "tone_level"), ("gone", "noise_tail")


def _text(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x)


def _named(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


@query(f"""WITH {base.SUMMARY}, g(gate, metric, side, stat, op, threshold, severity) AS (VALUES {base.values(base.GATES)}),
f(gate, metric, op, threshold, severity, n_verdicts, source) AS (VALUES {', '.join('(' + ', '.join(map(_text, r)) + ')' for r in FRESH)}),
j AS (SELECT coalesce(g.gate, f.gate) AS gate, g.gate IS NOT NULL AND coalesce(g.gate, f.gate) IN ({_named(FIXED)}) AS whole, g.gate IS NOT NULL AND coalesce(g.gate, f.gate) IN ({_named(DISPLAY)}) AS shown,
    coalesce(f.source = 'floor' AND f.n_verdicts = 0, false) AS untested, g.metric AS gm, g.op AS go, g.threshold AS gt, g.severity AS gs, f.metric AS fm, f.op AS fo, f.threshold AS ft, f.severity AS fs, f.source
  FROM g FULL JOIN f ON g.gate = f.gate WHERE g.gate IS NOT NULL OR f.gate NOT IN ({_named(RETIRED)})),
p AS (SELECT gate, CASE WHEN whole THEN gm ELSE coalesce(fm, gm) END AS metric, CASE WHEN whole THEN go ELSE coalesce(fo, go) END AS op,
    CASE WHEN whole OR ft IS NULL THEN gt WHEN gt IS NULL OR NOT untested THEN ft WHEN coalesce(fo, go) = '<=' THEN greatest(ft, gt) WHEN coalesce(fo, go) = '>=' THEN least(ft, gt) ELSE greatest(abs(ft), abs(gt)) END AS threshold,
    CASE WHEN whole OR shown THEN gs ELSE coalesce(fs, gs) END AS severity, NOT whole AND source IS NOT NULL AND NOT untested AS calibrated FROM j)
SELECT gate, severity, calibrated, threshold, count(s.median) AS n, count(CASE WHEN CASE op WHEN '<=' THEN median <= threshold WHEN '>=' THEN median >= threshold ELSE abs(median) <= threshold END THEN 1 END) AS passed
FROM p LEFT JOIN summary s ON s.metric = p.metric AND s.side = 'delta' GROUP BY ALL""")
def protected_gates(spark, d):
    """How many candidates pass each gate once fresh entries are laid over, with what protects some of them."""
    kinds = "gate string, metric string, op string, threshold double, severity string"
    p = decisions.protected(base.gates(spark), spark.createDataFrame(FRESH, kinds + ", n_verdicts int, source string"), FIXED, DISPLAY, RETIRED)
    s = base.summary(spark, d).where("side = 'delta'").select("metric", "median")
    good = F.when(F.col("op") == "<=", F.col("median") <= F.col("threshold")).when(F.col("op") == ">=", F.col("median") >= F.col("threshold")).otherwise(F.abs("median") <= F.col("threshold"))
    return p.join(s, "metric", "left").groupBy("gate", "severity", "calibrated", "threshold").agg(F.count("median").alias("n"), F.count_if(good).alias("passed"))


#: reading, worse, multiple of its floor
VETOES = [("noise.delta.median", "up", 0.03), ("tone.delta.median", "down", 0.05), ("drop.delta.median", "up", 0.04)]
STEPS = base.FLAT + f""", centre AS (SELECT metric, quantile_cont(delta, 0.5) AS c FROM deltas GROUP BY metric),
floors AS (SELECT metric || '.delta.median' AS reading, max(p) AS floor FROM (SELECT metric, tape, quantile_cont(abs(delta - c), 0.95) AS p FROM deltas JOIN centre USING (metric) GROUP BY metric, tape) GROUP BY metric),
rules(reading, worse, multiple) AS (VALUES {base.values(VETOES)}),
known AS (SELECT tape, candidate, reading, CASE WHEN NOT (tape = 3 AND candidate = '1-URGENT' AND reading = 'drop.delta.median') THEN value END AS value FROM flat),
steps AS (SELECT c.tape, c.candidate, r.reading, multiple * floor AS lim, CASE worse WHEN 'up' THEN k.value - i.value ELSE i.value - k.value END AS step
  FROM (SELECT DISTINCT tape, candidate FROM known WHERE candidate <> '{INCUMBENT}') c CROSS JOIN rules r JOIN floors f ON f.reading = r.reading JOIN known i ON i.tape = c.tape AND i.candidate = '{INCUMBENT}' AND i.reading = r.reading AND i.value IS NOT NULL
  LEFT JOIN known k ON k.tape = c.tape AND k.candidate = c.candidate AND k.reading = r.reading)"""


def flat(spark, d, x, s):
    """Flat readings of the summary ``s``, one of them lost, and the benign floors of the readings ``x``."""
    spread = base.deviations(x)
    floors = spread.groupBy(F.concat("metric", F.lit(".delta.median")).alias("reading")).agg(F.max("p95").alias("floor"))
    gone = (F.col("tape") == 3) & (F.col("candidate") == "1-URGENT") & (F.col("reading") == "drop.delta.median")
    return scoring.flattened(s).withColumn("value", F.when(~gone, F.col("value"))), floors


def steps(spark, d):
    x = layout.cut(scoring.deltas(v.readings(spark, d)))
    f, floors = flat(spark, d, x, scoring.summarise(x, base.specs(spark)))
    rules = decisions.limited(spark.createDataFrame(VETOES, "reading string, worse string, multiple double"), floors)
    return layout.cut(decisions.against(layout.cut(f), INCUMBENT, rules))


@query(f"WITH {STEPS} SELECT tape, candidate, reading, coalesce(step > lim, true) AS vetoed FROM steps")
def veto_trips(spark, d):
    """Readings that step further for the worse than so many of their benign floors; a lost one trips."""
    return decisions.vetoed(steps(spark, d))


FAMILY = f"""clips AS (SELECT candidate, reading, count(*) AS clips, count_if(coalesce(step > 0.05, true))::BIGINT AS worse, count_if(coalesce(step < -0.05, false))::BIGINT AS better, count_if(coalesce(step > lim, true))::BIGINT AS past FROM steps GROUP BY ALL),
tests AS (SELECT *, CASE WHEN worse + better = 0 THEN 1.0 ELSE list_sum(list_transform(range(worse, worse + better + 1), lambda k: round(exp(lgamma(worse + better + 1) - lgamma(k + 1) - lgamma(worse + better - k + 1))) / pow(2, worse + better))) END AS p FROM clips),
o AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY p, reading) AS i, count(*) OVER (PARTITION BY candidate) AS m FROM tests),
h AS (SELECT *, max((p > 0.2::DOUBLE / (m - i + 1))::INTEGER) OVER (PARTITION BY candidate ORDER BY i) = 0 AS rejected FROM o),
family AS (SELECT candidate, reading, clips, worse, better, past, p, past >= ceil(clips * {1 / 3!r}::DOUBLE) AND CASE WHEN clips >= ceil(log2(greatest({len(VETOES)}, 1) / 0.2::DOUBLE)) THEN rejected ELSE worse = clips END AS vetoed FROM h)"""


@query(f"WITH {STEPS}, {FAMILY} SELECT candidate, reading, clips, worse, better, past, round(p, 8) AS p, vetoed FROM family")
def family_vetoes(spark, d):
    """Vetoes that hold over all tapes of a candidate, by sign tests and Holm's procedure over its readings."""
    return decisions.family_vetoes(steps(spark, d), jitter=0.05, alpha=0.2).withColumn("p", F.round("p", 8))


@query(f"""WITH s AS (SELECT p_brand AS candidate, split_part(p_type, ' ', 1) AS key, avg(p_retailprice) AS value FROM part GROUP BY ALL), b AS (SELECT key, quantile_cont(value, 0.75) AS hi, quantile_cont(value, 0.25) AS lo FROM s GROUP BY key),
i AS (SELECT min(candidate) AS candidate FROM s), now AS (SELECT key, value AS now FROM s WHERE candidate = (SELECT candidate FROM i)), rules AS (SELECT key, hi AS bound, 1::DOUBLE AS side FROM b UNION ALL SELECT key, lo, -1 FROM b)
SELECT candidate, key, round(value, 6) AS value, round(bound, 6) AS bound, side FROM s JOIN rules USING (key) LEFT JOIN now USING (key) WHERE (now IS NULL OR side * (value - now) > 0) AND side * (value - bound) >= 0""")
def refused_settings(spark, d):
    """Settings of each brand that step to a bound which the quartiles of all brands set, on either side of the first brand's."""
    s = v.table(spark, d, "part").groupBy(F.col("p_brand").alias("candidate"), F.split("p_type", " ")[0].alias("key")).agg(F.avg("p_retailprice").alias("value"))
    s = layout.cut(s)
    q = layout.quantiles(s, ["key"], "value", hi=0.75, lo=0.25)
    rules = q.select("key", F.explode(F.array(F.struct(F.col("hi").alias("bound"), F.lit(1.0).alias("side")), F.struct(F.col("lo").alias("bound"), F.lit(-1.0).alias("side")))).alias("r")).select("key", "r.*")
    now = scoring.with_each(s, s.agg(F.min("candidate").alias("first"))).where("candidate = first").select("key", "value")
    r = decisions.refused(s, now, rules)
    return r.select("candidate", "key", F.round("value", 6).alias("value"), F.round("bound", 6).alias("bound"), "side")


CHECKED = f"""fails AS (SELECT tape, candidate, count_if(status = 'failed' AND severity = 'hard') AS hard, count_if(status = 'failed' AND severity = 'soft') AS soft FROM verdicts GROUP BY tape, candidate),
heard AS (SELECT c.tape, c.candidate, bool_and(abs(c.value - i.value) <= c.tie) AS inaudible, bool_or(coalesce(c.raw - i.raw > 1.5, c.raw IS NULL)) AS guarded FROM d0 c JOIN d0 i ON i.tape = c.tape AND i.reading = c.reading AND i.candidate = '{INCUMBENT}' AND i.value IS NOT NULL GROUP BY c.tape, c.candidate),
states AS (SELECT f.tape, f.candidate, CASE WHEN f.hard > i.hard OR guarded THEN 'excluded' WHEN inaudible AND f.candidate <> '{INCUMBENT}' THEN 'tie' WHEN f.soft > i.soft THEN 'capped' ELSE 'ok' END AS status
  FROM fails f JOIN fails i ON i.tape = f.tape AND i.candidate = '{INCUMBENT}' JOIN heard h ON h.tape = f.tape AND h.candidate = f.candidate)"""


@query(f"""WITH {base.FLAT}, {base.VERDICTS[len(base.SUMMARY) + 2:]}, d0 AS (SELECT * REPLACE (CASE WHEN value IS NOT NULL THEN weight * greatest(0, abs(value - target) - dead_zone) / scale END AS raw) FROM dist), {CHECKED},
live AS (SELECT d0.*, coalesce(d0.raw, max(d0.raw) OVER (PARTITION BY d0.tape, d0.reading) + weight) AS dd FROM d0 JOIN states s ON s.tape = d0.tape AND s.candidate = d0.candidate AND s.status IN ('ok', 'capped')),
sums AS (SELECT a.tape, a.candidate, b.candidate AS other, a.family, sum(a.dd - b.dd) AS gap, sum(greatest(a.band, b.band)) AS band FROM live a JOIN live b ON a.tape = b.tape AND a.reading = b.reading AND a.candidate <> b.candidate WHERE a.dd IS NOT NULL AND b.dd IS NOT NULL GROUP BY ALL),
rates AS (SELECT tape, candidate, family, avg(CASE WHEN abs(gap) <= band THEN 0.5 WHEN gap < 0 THEN 1.0 ELSE 0.0 END::DOUBLE) AS rate FROM sums GROUP BY ALL),
worst AS (SELECT tape, candidate, arg_min(family, {{'rate': rate, 'family': family}}) AS family, min(rate) AS rate FROM rates GROUP BY tape, candidate)
SELECT s.tape, s.candidate, CASE WHEN status IN ('ok', 'capped') AND rate IS NULL THEN 'unrated' ELSE status END AS status, CASE WHEN status IN ('ok', 'capped') THEN family END AS family,
  round(CASE WHEN status = 'excluded' THEN 0 WHEN status = 'tie' OR rate IS NULL THEN 0.5 WHEN status = 'capped' THEN least(rate, 0.5) ELSE rate END, 6)::DOUBLE AS reward, status = 'ok' AND rate IS NOT NULL AS may_win
FROM states s LEFT JOIN worst w ON w.tape = s.tape AND w.candidate = s.candidate""")
def candidate_rewards(spark, d):
    """Rewards of candidates under their gates, flags and guards against the incumbent: some are out, tie or are capped."""
    s = base.summary(spark, d)
    t = scoring.verdicts(s, base.gates(spark))
    count = lambda severity: F.count_if((F.col("status") == "failed") & (F.col("severity") == severity))
    fails = layout.cut(t.groupBy("tape", "candidate").agg(count("hard").alias("hard"), count("soft").alias("soft")))
    dist = layout.cut(scoring.distances(scoring.flattened(s), base.grid(spark)))
    theirs = dist.where((F.col("candidate") == INCUMBENT) & F.col("value").isNotNull()).select("tape", "reading", F.col("value").alias("now"), F.col("raw").alias("bar"))
    mine = dist.join(theirs, ["tape", "reading"]).groupBy("tape", "candidate").agg(
        F.bool_and(F.abs(F.col("value") - F.col("now")) <= F.col("tie")).alias("near"), F.bool_or(F.coalesce(F.col("raw") - F.col("bar") > 1.5, F.col("raw").isNull())).alias("dsp_guard"))
    i = fails.where(F.col("candidate") == INCUMBENT).select("tape", F.col("hard").alias("hard0"), F.col("soft").alias("soft0"))
    none = F.lit(False)
    checks = fails.join(i, "tape").join(mine, ["tape", "candidate"]).select(
        "tape", "candidate", (F.col("hard") > F.col("hard0")).alias("hard_gate"), (F.col("soft") > F.col("soft0")).alias("listener_flag"),
        (F.col("near") & (F.col("candidate") != INCUMBENT)).alias("inaudible"), none.alias("verdict_reversal"), none.alias("learned_veto"), "dsp_guard",
    )
    return decisions.rewards(dist, layout.cut(decisions.statuses(checks))).withColumn("reward", F.round("reward", 6))


@query(f"""WITH k AS ({programme.SQL['k_loudness']}), p AS (SELECT l_suppkey AS track, 20 * log10(max(abs((l_extendedprice - 50000) / 50000)) + 1e-12) AS peak, count(*) / {programme.RATE}::DOUBLE AS seconds FROM lineitem GROUP BY l_suppkey),
b AS (SELECT track, loudness, lra, round(peak, 5) AS peak, CASE WHEN seconds > 0 AND seconds < 3 THEN [] WHEN loudness IS NULL OR loudness = 0 OR lra = 0 THEN ['unreadable']
  ELSE list_filter([CASE WHEN lra > 20 THEN 'range' END, CASE WHEN round(peak, 5) + (-16 - loudness) > -1 THEN 'true peak' END], lambda w: w IS NOT NULL) END AS blockers FROM k JOIN p USING (track))
SELECT track, loudness, lra, peak, array_to_string(blockers, '+') AS blockers, CASE WHEN len(blockers) = 0 THEN 'linear' WHEN blockers = ['true peak'] AND loudness IS NOT NULL THEN 'limited' ELSE 'dynamic' END AS stage FROM b""")
def loudness_stage(spark, d):
    """What keeps the loudness stage of each track from being linear, and what it does then."""
    x = layout.kept_blocks(v.signal_long(spark, d), "x")
    k = filters.loudness(x, programme.RATE, programme.CELL).select("track", F.round("loudness", 5).alias("loudness"), F.round("lra", 5).alias("lra"))
    p = layout.unblocked(x, "x").groupBy("track").agg(F.round(20 * F.log10(F.max(F.abs("x")) + 1e-12), 5).alias("peak"), (F.count("*") / programme.RATE).alias("seconds"))
    b = k.join(p, "track").withColumn("b", decisions.linear_blockers(F.col("loudness"), F.col("peak"), F.col("lra"), F.col("seconds")))
    return b.select("track", "loudness", "lra", "peak", F.array_join("b", "+").alias("blockers"), decisions.stage(F.col("b"), F.col("loudness")).alias("stage"))
