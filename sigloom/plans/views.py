"""Views that give the base tables the shapes of signals and scores, in Spark and as SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.operators import layout

#: Samples of a frame in the registered queries.
FRAME = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01', {ts})") / 1e6


def signal_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, ix, t (seconds), x: the events of each user in time order."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("track"), "ts", "event_id", F.col("value").alias("x"))
    out = layout.numbered(e, ["track"], ["ts", "event_id"], F.date_trunc("day", "ts"))
    return out.select("track", "ix", seconds("ts").alias("t"), "x")


EVENTS = """signal_events AS (
  SELECT user_id AS track, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ix,
         (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01'))::DOUBLE / 1e6 AS t, value AS x FROM events)"""


def signal_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, ix, channel, x (-1 to 1): the line items of each supplier by ship date."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("track"), "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey",
        (F.col("l_linenumber") % 2).alias("channel"), ((F.col("l_extendedprice") - 50000) / 50000).alias("x"),
    )
    out = layout.numbered(li, ["track"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"], F.col("l_shipdate"))
    return out.select("track", "ix", "channel", "x")


LONG = """signal_long AS (
  SELECT l_suppkey AS track, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS ix,
         l_linenumber % 2 AS channel, (l_extendedprice - 50000) / 50000 AS x FROM lineitem)"""


def pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, ix, src, out: a source and its two-tap mean."""
    s = layout.lagged(signal_events(spark, sf_dir), ["track"], before=("x", 1))
    return s.select("track", "ix", F.col("x").alias("src"), (0.5 * F.col("x") + 0.5 * F.coalesce("before", "x")).alias("out"))


PAIR = EVENTS + """, pair AS (
  SELECT track, ix, x AS src, 0.5 * x + 0.5 * coalesce(lag(x) OVER (PARTITION BY track ORDER BY ix), x) AS out FROM signal_events)"""


def frame_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, fix, ls, lo: levels (root mean square) of source and output in whole frames."""
    g = pair(spark, sf_dir).groupBy("track", F.floor(F.col("ix") / FRAME).alias("fix"))
    levels = g.agg(F.sqrt(F.avg(F.col("src") * F.col("src"))).alias("ls"), F.sqrt(F.avg(F.col("out") * F.col("out"))).alias("lo"), F.count("*").alias("n"))
    return layout.cut(levels.where(F.col("n") == FRAME).drop("n"))  # read again by most queries, an eighth of the rows


FRAME_PAIRS = PAIR + f""", frame_pairs AS (
  SELECT track, ix // {FRAME} AS fix, sqrt(avg(src * src)) AS ls, sqrt(avg(out * out)) AS lo
  FROM pair GROUP BY track, ix // {FRAME} HAVING count(*) = {FRAME})"""


def frame_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, fix, level: levels of the long tracks in whole frames."""
    return levels(signal_long(spark, sf_dir))


def levels(samples: DataFrame) -> DataFrame:
    g = samples.groupBy("track", F.floor(F.col("ix") / FRAME).alias("fix"))
    return layout.cut(g.agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("level"), F.count("*").alias("n")).where(F.col("n") == FRAME).drop("n"))


FRAME_LEVELS = LONG + f""", frame_levels AS (
  SELECT track, ix // {FRAME} AS fix, sqrt(avg(x * x)) AS level FROM signal_long GROUP BY track, ix // {FRAME} HAVING count(*) = {FRAME})"""


def frames64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, frame_ix, x: the embeddings as frames of 64 samples, numbered within their label."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("track"), F.col("vec_id").alias("frame_ix"), F.col("embedding").cast("array<double>").alias("x"))
    return e.where(F.size("x") == 64)


FRAMES64 = """frames64 AS (
  SELECT label AS track, vec_id AS frame_ix, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings WHERE len(embedding) = 64)"""

POWER64 = FRAMES64 + """, power64 AS (
  SELECT track, frame_ix, list_transform(range(0, 33), lambda k:
    pow(list_sum(list_transform(range(0, 64), lambda i: x[i + 1] * cos(k * i * (2 * pi() / 64)))), 2) +
    pow(list_sum(list_transform(range(0, 64), lambda i: x[i + 1] * sin(k * i * (2 * pi() / 64)))), 2)) AS p FROM frames64)"""


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tape, candidate, win, route, metric, src, out: scores of line items as paired readings, with gaps.

    A window is an order, a candidate its priority, and three numbers of its lines play source and output.
    """
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("win"), (F.col("o_custkey") % 8).alias("tape"), F.col("o_orderpriority").alias("candidate"), F.col("o_orderstatus").alias("route"))
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("win")).agg(
        F.round(F.avg("l_quantity"), 4).alias("q"), F.round(F.max("l_quantity"), 4).alias("q2"), F.round(F.avg("l_discount") * 100, 4).alias("d"),
        F.round(F.max("l_discount") * 100, 4).alias("d2"), F.round(F.avg("l_tax") * 100, 4).alias("x"), F.round(F.min("l_tax") * 100, 4).alias("x2"),
    )
    rows = o.join(li, "win")
    metrics = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(a).alias("src"), F.col(b).alias("out")) for n, a, b in (("noise", "q", "q2"), ("tone", "d", "d2"), ("drop", "x", "x2"))])
    m = rows.select("tape", "candidate", "win", "route", F.explode(metrics).alias("m")).select("tape", "candidate", "win", "route", "m.*")
    return m.withColumn("out", F.when((F.col("win") % 11 != 0) | (F.col("metric") != "drop"), F.col("out")))


READINGS = """per_order AS (
  SELECT l_orderkey AS win, round(avg(l_quantity), 4) AS q, round(max(l_quantity), 4) AS q2, round(avg(l_discount) * 100, 4) AS d,
         round(max(l_discount) * 100, 4) AS d2, round(avg(l_tax) * 100, 4) AS x, round(min(l_tax) * 100, 4) AS x2
  FROM lineitem GROUP BY l_orderkey),
wide AS (SELECT o.o_custkey % 8 AS tape, o.o_orderpriority AS candidate, o.o_orderkey AS win, o.o_orderstatus AS route, p.* EXCLUDE (win)
  FROM orders o JOIN per_order p ON o.o_orderkey = p.win),
readings AS (
  SELECT tape, candidate, win, route, 'noise' AS metric, q AS src, q2 AS out FROM wide UNION ALL
  SELECT tape, candidate, win, route, 'tone', d, d2 FROM wide UNION ALL
  SELECT tape, candidate, win, route, 'drop', x, CASE WHEN win % 11 <> 0 THEN x2 END FROM wide)"""


def filter_steps(samples: str, cutoff: float) -> str:
    """Common table expressions that run the second-order high-pass over ``samples`` (track, ix, x): steps has y of each."""
    w = 2 * math.pi * cutoff
    alpha, cos = math.sin(w) / (2 * 0.70710678), math.cos(w)
    a0 = 1 + alpha
    b0, b1, a1, a2 = (1 + cos) / 2 / a0, -(1 + cos) / a0, -2 * cos / a0, (1 - alpha) / a0
    return f"""steps AS (
  SELECT track, ix, x, 0::DOUBLE AS x1, {b0!r}::DOUBLE * x AS y, 0::DOUBLE AS y1 FROM {samples} WHERE ix = 0 UNION ALL
  SELECT n.track, n.ix, n.x, s.x, {b0!r}::DOUBLE * n.x + {b1!r}::DOUBLE * s.x + {b0!r}::DOUBLE * s.x1 - {a1!r}::DOUBLE * s.y - {a2!r}::DOUBLE * s.y1, s.y
  FROM steps s JOIN {samples} n ON n.track = s.track AND n.ix = s.ix + 1)"""
