"""Queries that drain the events table through Structured Streaming, with the SQL of their batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloom.plans import views as v
from sigloom.streaming import blocks

HOP = 450 * 60


NUMBERED = "numbered AS MATERIALIZED (SELECT event_id, user_id AS track, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ix, value AS x FROM events)"
SQL: dict[str, str] = {
    "stream_tumbling": "SELECT event_type AS track, time_bucket(INTERVAL 6 HOURS, ts) AS start, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL",
    "stream_sliding": f"""WITH hopped AS (SELECT event_type AS track, epoch_us(ts) // {HOP}000000 AS k, value FROM events)
SELECT track, make_timestamp((k - back) * {HOP}000000) AS start, count(*) AS n, round(max(value), 6) AS top FROM hopped, (VALUES (0), (1)) b(back) GROUP BY ALL""",
    "stream_session": """WITH e AS (SELECT user_id AS track, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOURS, true)::INTEGER AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY track ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT track, min(ts) AS start, count(*) AS n FROM s GROUP BY track, k""",
    "stream_filter_state": f"WITH RECURSIVE {NUMBERED}, {v.filter_steps('numbered', 0.05)} SELECT n.event_id, track, round(y, 6) AS y FROM steps JOIN numbered n USING (track, ix)",
    "stream_overlap_add": f"WITH {v.EVENTS} SELECT track, ix, round(x * CASE WHEN ix < 4 THEN pow(sin(pi() * (ix + 0.5) / 8), 2) ELSE 1 END, 6) AS y FROM signal_events",
}


def stream_tumbling(spark, d):
    return _start(blocks.drained(spark, f"{d}/events.parquet", blocks.tumbling))


def stream_sliding(spark, d):
    return _start(blocks.drained(spark, f"{d}/events.parquet", blocks.sliding))


def stream_session(spark, d):
    return _start(blocks.drained(spark, f"{d}/events.parquet", blocks.sessions))


def stream_filter_state(spark, d):
    return blocks.drained(spark, f"{d}/events.parquet", blocks.filtered).withColumn("y", F.round("y", 6))


def stream_overlap_add(spark, d):
    return blocks.drained(spark, f"{d}/events.parquet", blocks.overlap_added).withColumn("y", F.round("y", 6))


def _start(windows):
    return windows.withColumn("start", F.col("start").cast("timestamp_ntz"))


QUERIES: dict = {f.__name__: f for f in (stream_tumbling, stream_sliding, stream_session, stream_filter_state, stream_overlap_add)}
