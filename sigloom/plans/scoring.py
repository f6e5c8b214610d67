"""Queries of the scoring warehouse: routed summaries, gates, distances, ranks, rewards, tests, floors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sigloom.operators import layout, scoring
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


#: metric, better (higher, lower, two), target, routes on which it is read
SPECS = [("noise", "lower", 0.0, ["F", "O", "P"]), ("tone", "higher", 0.0, ["F", "O"]), ("drop", "two", -2.0, ["O", "P"])]
#: gate, metric, side, stat, op, threshold, severity
GATES = [("noise_tail", "noise", "delta", "tail", "<=", 25.0, "hard"), ("tone_median", "tone", "delta", "median", ">=", 2.2, "hard"), ("tone_level", "tone", "out", "median", ">=", 7.5, "soft"), ("drop_size", "drop", "delta", "median", "abs<=", 2.3, "soft"), ("missing", "ghost", "delta", "median", "<=", 1.0, "hard")]
#: reading (metric.side.stat), ix, family, target, dead zone, scale, weight, tie
GRID = [("noise.delta.median", 0, "level", 13.0, 0.5, 2.0, 1.0, 0.05), ("noise.delta.tail", 1, "level", 24.0, 0.0, 4.0, 0.5, 0.05), ("tone.delta.median", 2, "timbre", 2.5, 0.1, 0.5, 1.0, 0.1), ("drop.delta.median", 3, "timbre", -2.0, 0.1, 0.4, 1.5, 0.1)]


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else "[" + ", ".join(f"'{y}'" for y in x) + "]" if isinstance(x, list) else f"{x}::DOUBLE" if isinstance(x, float) else str(x) for x in r) + ")" for r in rows)


def specs(spark):
    return spark.createDataFrame(SPECS, "metric string, better string, target double, routes array<string>")


def gates(spark):
    return spark.createDataFrame(GATES, "gate string, metric string, side string, stat string, op string, threshold double, severity string")


def grid(spark):
    return spark.createDataFrame(GRID, "reading string, ix int, family string, target double, dead_zone double, scale double, weight double, tie double")


DELTAS = v.READINGS + f""", specs(metric, better, target, routes) AS (VALUES {values(SPECS)}),
deltas AS (SELECT * , out - src AS delta FROM readings WHERE isfinite(src) AND isfinite(out))"""
SUMMARY = DELTAS + """, sides AS (
  SELECT tape, candidate, metric, 'delta' AS side, delta AS x, route FROM deltas UNION ALL
  SELECT tape, candidate, metric, 'src', src, route FROM deltas UNION ALL SELECT tape, candidate, metric, 'out', out, route FROM deltas),
q AS (SELECT tape, candidate, s.metric, side, better, target, quantile_cont(x, 0.1) AS p10, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.9) AS p90,
        quantile_cont(x, 0.95) AS p95, max(x) AS top, count(*) AS n FROM sides s JOIN specs p ON s.metric = p.metric AND list_contains(routes, route)
  GROUP BY tape, candidate, s.metric, side, better, target),
summary AS (SELECT tape, candidate, metric, side, median, CASE better WHEN 'higher' THEN p10 WHEN 'lower' THEN p90
    ELSE CASE WHEN abs(p10 - target) > abs(p90 - target) THEN p10 ELSE p90 END END AS tail, p95, top, n FROM q)"""


def summary(spark, d):
    return layout.cut(scoring.summarise(scoring.deltas(v.readings(spark, d)), specs(spark)))  # a few rows a tape


@query(f"WITH {DELTAS} SELECT tape, candidate, win, metric, round(delta, 4) AS delta FROM deltas")
def window_delta(spark, d):
    return scoring.deltas(v.readings(spark, d)).select("tape", "candidate", "win", "metric", F.round("delta", 4).alias("delta"))


@query(f"WITH {SUMMARY} SELECT tape, candidate, metric, side, round(median, 9) AS median, round(tail, 9) AS tail, round(p95, 9) AS p95, round(top, 9) AS top, n FROM summary")
def scorecard_aggregate(spark, d):
    return summary(spark, d).select("tape", "candidate", "metric", "side", *[F.round(c, 9).alias(c) for c in ("median", "tail", "p95", "top")], "n")


VERDICTS = SUMMARY + f""", gates(gate, metric, side, stat, op, threshold, severity) AS (VALUES {values(GATES)}),
cands AS (SELECT DISTINCT tape, candidate FROM summary),
verdicts AS (
  SELECT c.tape, c.candidate, g.gate, g.severity, CASE g.stat WHEN 'tail' THEN s.tail ELSE s.median END AS value, g.threshold,
    CASE WHEN value IS NULL THEN 'skipped' WHEN CASE g.op WHEN '<=' THEN value <= threshold WHEN '>=' THEN value >= threshold ELSE abs(value) <= threshold END THEN 'passed' ELSE 'failed' END AS status
  FROM cands c CROSS JOIN gates g LEFT JOIN summary s ON s.tape = c.tape AND s.candidate = c.candidate AND s.metric = g.metric AND s.side = g.side)"""


@query(f"WITH {VERDICTS} SELECT tape, candidate, gate, severity, round(value, 9) AS value, threshold, status FROM verdicts")
def gate_verdicts(spark, d):
    return scoring.verdicts(summary(spark, d), gates(spark)).withColumn("value", F.round("value", 9))


@query(f"""WITH {VERDICTS} SELECT tape, candidate, count_if(status = 'failed' AND severity = 'hard') AS hard_failures, count_if(status = 'failed' AND severity = 'soft') AS flags,
  count_if(status = 'skipped') AS skipped FROM verdicts GROUP BY tape, candidate""")
def gate_failures(spark, d):
    t = scoring.verdicts(summary(spark, d), gates(spark))
    failed = F.col("status") == "failed"
    return t.groupBy("tape", "candidate").agg(F.count_if(failed & (F.col("severity") == "hard")).alias("hard_failures"), F.count_if(failed & (F.col("severity") == "soft")).alias("flags"), F.count_if(F.col("status") == "skipped").alias("skipped"))


OVERLAY = [("noise_tail", 20.0, True), ("tone_median", 3.0, False), ("drop_size", 5.0, False)]


@query(f"""WITH {SUMMARY}, gates0(gate, metric, side, stat, op, threshold, severity) AS (VALUES {values(GATES)}), f(gate, fresh, verdicted) AS (VALUES {values([(a, b, str(c).lower()) for a, b, c in OVERLAY])}),
gates AS (SELECT gates0.* REPLACE (CASE WHEN fresh IS NULL THEN threshold WHEN verdicted = 'true' THEN fresh WHEN op = '>=' THEN least(threshold, fresh) ELSE greatest(threshold, fresh) END AS threshold) FROM gates0 LEFT JOIN f USING (gate)),
{VERDICTS[VERDICTS.index("cands AS"):]} SELECT tape, candidate, gate, threshold, status FROM verdicts""")
def gate_overlay(spark, d):
    """Verdicts under gates that fresh bounds overlay."""
    fresh = spark.createDataFrame(OVERLAY, "gate string, fresh double, verdicted boolean")
    return scoring.verdicts(summary(spark, d), scoring.overlaid(gates(spark), fresh)).select("tape", "candidate", "gate", "threshold", "status")


FLAT = SUMMARY + f""", flat AS (SELECT tape, candidate, metric || '.' || side || '.' || stat AS reading, value FROM
  (SELECT tape, candidate, metric, side, 'median' AS stat, median AS value FROM summary UNION ALL SELECT tape, candidate, metric, side, 'tail', tail FROM summary)),
grid(reading, ix, family, target, dead_zone, scale, weight, tie) AS (VALUES {values(GRID)}),
spine AS (SELECT DISTINCT s.tape, s.candidate, g.* FROM summary s CROSS JOIN grid g),
dist AS (SELECT p.*, f.value, CASE WHEN f.value IS NOT NULL AND NOT (p.tape = 3 AND p.candidate = '1-URGENT' AND p.ix = 3) THEN p.weight * greatest(0, abs(f.value - p.target) - p.dead_zone) / p.scale END AS raw,
    p.weight * least(p.tie, greatest(0, abs(f.value - p.target) + p.tie - p.dead_zone)) / p.scale AS band
  FROM spine p LEFT JOIN flat f ON f.tape = p.tape AND f.candidate = p.candidate AND f.reading = p.reading),
filled AS (SELECT *, coalesce(raw, max(raw) OVER (PARTITION BY tape, reading) + weight) AS dist FROM dist)"""


def lost(dist):
    """One reading of one candidate taken away, so that filling has something to do."""
    gone = (F.col("tape") == 3) & (F.col("candidate") == "1-URGENT") & (F.col("ix") == 3)
    return dist.withColumn("raw", F.when(~gone, F.col("raw")))


def filled(spark, d):
    return layout.cut(scoring.fill_missing(lost(scoring.distances(scoring.flattened(summary(spark, d)), grid(spark)))))


@query(f"WITH {FLAT} SELECT tape, candidate, reading, round(value, 9) AS value FROM flat")
def map_flatten(spark, d):
    return scoring.flattened(summary(spark, d)).withColumn("value", F.round("value", 9))


@query(f"WITH {FLAT} SELECT tape, candidate, reading, round(raw, 9) AS raw, round(band, 9) AS band, round(dist, 9) AS dist FROM filled")
def two_sided_distance(spark, d):
    return filled(spark, d).select("tape", "candidate", "reading", *[F.round(c, 9).alias(c) for c in ("raw", "band", "dist")])


POINTS = FLAT + """, sums AS (SELECT a.tape, a.candidate AS a, b.candidate AS b, a.family, sum(a.dist - b.dist) AS gap, sum(greatest(a.band, b.band)) AS band
  FROM filled a JOIN filled b ON a.tape = b.tape AND a.reading = b.reading AND a.candidate <> b.candidate GROUP BY a.tape, a.candidate, b.candidate, a.family),
points AS (SELECT tape, a AS candidate, b AS other, family, CASE WHEN abs(gap) <= band THEN 0.5 WHEN gap < 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS points FROM sums),
rates AS (SELECT tape, candidate, family, avg(points) AS rate FROM points GROUP BY tape, candidate, family)"""


@query(f"WITH {POINTS} SELECT * FROM points")
def pair_points(spark, d):
    return scoring.pair_points(filled(spark, d))


@query(f"WITH {POINTS} SELECT tape, candidate, family, round(rate, 6) AS rate FROM rates")
def family_win_rate(spark, d):
    return scoring.win_rates(scoring.pair_points(filled(spark, d))).withColumn("rate", F.round("rate", 6))


REWARD = POINTS + """, worst AS (SELECT tape, candidate, arg_min(family, {'rate': rate, 'family': family}) AS family, min(rate) AS rate FROM rates GROUP BY tape, candidate),
fails AS (SELECT tape, candidate, count_if(median > 14) > 0 AS tripped FROM summary WHERE metric = 'noise' AND side = 'delta' GROUP BY tape, candidate),
reward AS (SELECT tape, candidate, family AS worst_family, CASE WHEN tripped THEN 'capped' WHEN rate = 0.5 THEN 'tie' ELSE 'ok' END AS status,
  CASE WHEN tripped THEN least(rate, 0.25) ELSE rate END AS reward FROM worst JOIN fails USING (tape, candidate))"""


def reward(spark, d):
    s = summary(spark, d)
    rates = scoring.win_rates(scoring.pair_points(layout.cut(scoring.fill_missing(lost(scoring.distances(scoring.flattened(s), grid(spark)))))))
    trips = s.where("metric = 'noise' AND side = 'delta'").groupBy("tape", "candidate").agg((F.count_if(F.col("median") > 14) > 0).alias("tripped"))
    return scoring.rewards(rates, trips)


@query(f"WITH {REWARD} SELECT tape, candidate, worst_family, status, round(reward, 6) AS reward FROM reward")
def group_reward(spark, d):
    return reward(spark, d).withColumn("reward", F.round("reward", 6))


TOTALS = FLAT + """, totals AS (SELECT tape, candidate, sum(dist) AS total, sum(band) AS band FROM filled GROUP BY tape, candidate)"""


def totals(spark, d):
    return filled(spark, d).groupBy("tape", "candidate").agg(F.sum("dist").alias("total"), F.sum("band").alias("band"))


@query(f"""WITH {TOTALS} SELECT a.tape, a.candidate, round(1 + sum(CASE WHEN b.candidate = a.candidate THEN 0 WHEN abs(a.total - b.total) <= 0.3 THEN 0.5 WHEN b.total < a.total THEN 1 ELSE 0 END), 2)::DOUBLE AS rank
FROM totals a JOIN totals b USING (tape) GROUP BY a.tape, a.candidate""")
def tie_aware_rank(spark, d):
    return scoring.banded_ranks(totals(spark, d), ["tape"], "total", 0.3)


@query(f"""WITH RECURSIVE {TOTALS}, o AS (SELECT *, row_number() OVER (PARTITION BY tape ORDER BY total, candidate) AS k FROM totals),
b AS (SELECT tape, candidate, total, k, total AS anchor, 1 AS bucket FROM o WHERE k = 1 UNION ALL
  SELECT o.tape, o.candidate, o.total, o.k, CASE WHEN o.total - b.anchor <= 0.5 THEN b.anchor ELSE o.total END, CASE WHEN o.total - b.anchor <= 0.5 THEN b.bucket ELSE b.bucket + 1 END FROM b JOIN o ON o.tape = b.tape AND o.k = b.k + 1)
SELECT tape, candidate, bucket FROM b""")
def tie_buckets(spark, d):
    return scoring.tie_buckets(totals(spark, d), 0.5)


RANKS = TOTALS + """, ranks AS (SELECT tape, candidate, total, rank() OVER (PARTITION BY tape ORDER BY round(total, 1)) + (count(*) OVER (PARTITION BY tape, round(total, 1)) - 1) / 2.0 AS rank FROM totals)"""


@query(f"WITH {RANKS} SELECT tape, candidate, rank::DOUBLE AS rank FROM ranks")
def average_ranks(spark, d):
    return scoring.average_ranks(totals(spark, d).withColumn("total", F.round("total", 1)), ["tape"], "total").select("tape", "candidate", "rank")


@query(f"WITH {RANKS} SELECT candidate, round(sum((tape + 1) * rank) / sum(tape + 1), 6) AS mean_rank FROM ranks GROUP BY candidate")
def weighted_mean_rank(spark, d):
    r = scoring.average_ranks(totals(spark, d).withColumn("total", F.round("total", 1)), ["tape"], "total")
    return r.groupBy("candidate").agg(F.round(F.sum((F.col("tape") + 1) * F.col("rank")) / F.sum(F.col("tape") + 1), 6).alias("mean_rank"))


@query(f"WITH {TOTALS} SELECT tape, arg_min(candidate, {{'total': total, 'candidate': candidate}}) AS best, round(min(total), 9) AS total FROM totals GROUP BY tape")
def best_per_tape(spark, d):
    return totals(spark, d).groupBy("tape").agg(F.min_by("candidate", F.struct("total", "candidate")).alias("best"), F.round(F.min("total"), 9).alias("total"))


@query(f"""WITH {TOTALS}, means AS (SELECT candidate, avg(total) AS mean FROM totals GROUP BY candidate), one AS (SELECT min(mean) AS single FROM means), per AS (SELECT avg(m) AS oracle FROM (SELECT min(total) AS m FROM totals GROUP BY tape))
SELECT round(single, 9) AS single, round(oracle, 9) AS oracle, round(single - oracle, 9) AS gain FROM one, per""")
def oracle_gain(spark, d):
    """What choosing the best candidate for each tape would gain over the best single one."""
    t = totals(spark, d)
    one = t.groupBy("candidate").agg(F.avg("total").alias("m")).agg(F.min("m").alias("single"))
    per = t.groupBy("tape").agg(F.min("total").alias("m")).agg(F.avg("m").alias("oracle"))
    both = one.withColumn("oracle", F.lit(None).cast("double")).unionByName(per.withColumn("single", F.lit(None).cast("double"))).agg(F.max("single").alias("single"), F.max("oracle").alias("oracle"))
    return both.select(F.round("single", 9).alias("single"), F.round("oracle", 9).alias("oracle"), F.round(F.col("single") - F.col("oracle"), 9).alias("gain"))


MOVES = FLAT + """, moves AS (SELECT c.tape, c.candidate, c.reading, c.ix, c.raw AS mine, i.raw AS theirs, c.raw - i.raw AS move FROM dist c JOIN dist i ON i.tape = c.tape AND i.reading = c.reading AND i.candidate = '5-LOW' WHERE c.candidate <> '5-LOW')"""


def moves(spark, d):
    return scoring.moves(layout.cut(lost(scoring.distances(scoring.flattened(summary(spark, d)), grid(spark)))), "5-LOW")


@query(f"""WITH {MOVES} SELECT tape, candidate, reading, CASE WHEN mine IS NULL AND theirs IS NOT NULL THEN true WHEN move > 0 AND mine - 0.6 > 0 THEN greatest(move, mine - 0.6) > 0.4 ELSE false END AS trips FROM moves""")
def constraint_trips(spark, d):
    """Readings that got worse than the incumbent's by more than allowed, past a bound; a lost reading trips."""
    return scoring.trips(moves(spark, d), max_move=0.4, bound=0.6)


SIGNS = MOVES + """, signs AS (SELECT candidate, reading, count_if(move > 0.01)::BIGINT AS worse, count_if(move < -0.01)::BIGINT AS better FROM moves GROUP BY candidate, reading),
tests AS (SELECT *, CASE WHEN worse + better = 0 THEN 1.0 ELSE list_sum(list_transform(range(worse, worse + better + 1), lambda k: round(exp(lgamma(worse + better + 1) - lgamma(k + 1) - lgamma(worse + better - k + 1))) / pow(2, worse + better))) END AS p FROM signs)"""


@query(f"WITH {SIGNS} SELECT candidate, reading, worse, better, round(p, 8) AS p FROM tests")
def sign_test(spark, d):
    return scoring.sign_tests(moves(spark, d), 0.01).withColumn("p", F.round("p", 8))


@query(f"""WITH {SIGNS}, o AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY p, reading) AS i, count(*) OVER (PARTITION BY candidate) AS m FROM tests),
h AS (SELECT *, max((p > 0.1 / (m - i + 1))::INTEGER) OVER (PARTITION BY candidate ORDER BY i) AS missed FROM o) SELECT candidate, reading, i::INTEGER AS i, missed = 0 AS rejected FROM h""")
def holm(spark, d):
    return scoring.holm(scoring.sign_tests(moves(spark, d), 0.01), ["candidate"], 0.1)


def deviations(x):
    """metric, tape, p95: the 95 % quantile of deviations from the median of all; equal readings are one row before they meet it."""
    x = layout.cut(layout.counted(x, ["metric", "tape"], "delta"))
    centre = layout.quantiles(x, ["metric"], "delta", "_c", centre=0.5)
    off = layout.beside(x, centre, ["metric"]).withColumn("dev", F.abs(F.col("delta") - F.col("centre")))
    return layout.quantiles(off, ["metric", "tape"], "dev", "_c", p95=0.95)


@query(f"""WITH {DELTAS}, c AS (SELECT metric, quantile_cont(delta, 0.5) AS centre FROM deltas GROUP BY metric), t AS (SELECT metric, tape, quantile_cont(abs(delta - centre), 0.95) AS p95 FROM deltas JOIN c USING (metric) GROUP BY metric, tape)
SELECT metric, round(max(p95), 5) AS tie_floor, round(avg(p95), 5) AS mean_floor FROM t GROUP BY metric""")
def benign_floor(spark, d):
    """Floor of a metric: per tape the 95 % quantile of deviations from the median of all; the largest is the tie floor."""
    t = deviations(scoring.deltas(v.readings(spark, d)))
    return t.groupBy("metric").agg(F.round(F.max("p95"), 5).alias("tie_floor"), F.round(F.avg("p95"), 5).alias("mean_floor"))


@query("""SELECT r_name AS region, c_mktsegment AS segment, grouping(r_name, c_mktsegment)::INTEGER AS level, count(*) AS n, round(avg(l_discount), 8) AS discount, round(avg(l_extendedprice), 2) AS price
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY GROUPING SETS ((), (r_name), (c_mktsegment))""")
def benchmark_grouping_sets(spark, d):
    t = lambda n: v.table(spark, d, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    region, segment = F.col("r_name"), F.col("c_mktsegment")
    return j.groupingSets([[], [region], [segment]], region, segment).agg(F.grouping_id("r_name", "c_mktsegment").cast("int").alias("level"), F.count("*").alias("n"), F.round(F.avg("l_discount"), 8).alias("discount"), F.round(F.avg("l_extendedprice"), 2).alias("price")).select(region.alias("region"), segment.alias("segment"), "level", "n", "discount", "price")


@query(f"WITH {DELTAS} SELECT metric, tape, candidate, win, round(delta, 4) AS delta, rank FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY CASE metric WHEN 'tone' THEN delta WHEN 'noise' THEN -delta ELSE -abs(delta + 2) END, win)::INTEGER AS rank FROM deltas) WHERE rank <= 3")
def worst_windows(spark, d):
    """The three worst windows of each metric, by its direction."""
    x = scoring.deltas(v.readings(spark, d)).join(F.broadcast(specs(spark)), "metric")
    bad = F.when(F.col("better") == "higher", F.col("delta")).when(F.col("better") == "lower", -F.col("delta")).otherwise(-F.abs(F.col("delta") - F.col("target")))
    w = Window.partitionBy("metric").orderBy(bad, "win")
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 3).select("metric", "tape", "candidate", "win", F.round("delta", 4).alias("delta"), "rank")


@query("""WITH e AS (SELECT o_custkey % 8 AS shard, o_orderkey, o_totalprice AS size, o_orderdate FROM orders), c AS (SELECT *, sum(size) OVER (PARTITION BY shard ORDER BY o_orderdate DESC, o_orderkey DESC) AS kept FROM e)
SELECT shard, o_orderkey FROM c WHERE kept > 1e7""")
def lru_eviction(spark, d):
    """Entries to drop, oldest first, until the rest of a shard fits its cap."""
    e = v.table(spark, d, "orders").select((F.col("o_custkey") % 8).alias("shard"), "o_orderkey", F.col("o_totalprice").alias("size"), "o_orderdate")
    return scoring.over_cap(e, ["shard"], [F.desc("o_orderdate"), F.desc("o_orderkey")], F.col("o_orderdate"), "size", 1e7).select("shard", "o_orderkey")


@query("""WITH f AS (SELECT part.p_brand AS candidate, md5(p_type || p_size::VARCHAR) AS print, p_partkey FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY print ORDER BY p_partkey) AS k, first_value(p_partkey) OVER (PARTITION BY print ORDER BY p_partkey) AS twin FROM f)
SELECT p_partkey, twin FROM r WHERE k > 1""")
def inert_detection(spark, d):
    """Entries whose content repeats an earlier one's."""
    p = v.table(spark, d, "part").select("p_partkey", F.md5(F.concat("p_type", F.col("p_size").cast("string"))).alias("print"))
    first = p.groupBy("print").agg(F.min("p_partkey").alias("twin"))
    return p.join(first, "print").where(F.col("p_partkey") != F.col("twin")).select("p_partkey", "twin")
