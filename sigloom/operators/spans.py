"""Spans and their neighbours, rolling readings, chunks, interpolation and range joins; no window over a whole track."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.operators import layout
from sigloom.operators.layout import BLOCK

#: Time cells of a group.
CELLS = 4096


def isolated(spans: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Spans with no neighbour closer than ``gap`` on either side."""
    k = layout.numbered(spans.select(*keys, "start", "stop"), keys, ["start"], F.floor(F.col("start") / BLOCK), "_i")
    near = layout.lagged(k, keys, "_i", _p=("stop", 1), _n=("start", -1))
    far = (F.col("_p").isNull() | (F.col("start") - F.col("_p") >= gap)) & (F.col("_n").isNull() | (F.col("_n") - F.col("stop") >= gap))
    return near.where(far).select(*keys, "start", "stop")


def counted_around(spans: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """Spans with ``around``: how many start within ``reach`` positions, itself included."""
    h = layout.with_halo(spans.select(*keys, "start", "stop"), reach, reach, "start")
    w = Window.partitionBy(*keys, "_blk").orderBy("start").rangeBetween(-reach, reach)
    return layout.own(h.withColumn("around", F.count("*").over(w)))


def rolling_percentile(df: DataFrame, keys: list[str], ix: str, value: str, before: int, after: int, p: float, name: str) -> DataFrame:
    """Percentile of the rows from ``before`` back to ``after`` ahead (fewer at the ends)."""
    h = layout.with_halo(df, before, after, ix)
    return layout.own(h.withColumn(name, F.percentile(value, p).over(layout.in_block(keys, ix).rowsBetween(-before, after))))


def chunk_plan(lengths: DataFrame, limit: int, overlap: int, stride: int) -> DataFrame:
    """track, start, core_stop, read_start, read_stop of the chunks of tracks longer than ``limit`` frames."""
    if limit <= 2 * overlap:
        return lengths.limit(0).selectExpr("track", "0L AS start", "0L AS core_stop", "0L AS read_start", "0L AS read_stop")
    n = F.ceil(F.col("frames") / F.lit(float(limit - overlap)))
    core = (F.ceil(F.ceil(F.col("frames") / n) / stride) * stride).cast("long")
    c = lengths.where(F.col("frames") > limit).withColumn("core", core)
    s = c.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames") - 1, F.col("core"))))
    return s.select(
        "track", "start", F.least(F.col("start") + F.col("core"), F.col("frames")).alias("core_stop"),
        F.greatest(F.col("start") - overlap, F.lit(0)).alias("read_start"), F.least(F.col("start") + F.col("core") + overlap, F.col("frames")).alias("read_stop"),
    )


def crossfaded(copies: DataFrame, size: int, fade: int) -> DataFrame:
    """track, ix, y: chunks ``c`` (of ``size`` from c * size on, the one before reaching ``fade`` further) faded into each other."""
    o = F.col("ix") - F.col("c") * size
    rising = F.when((F.col("c") > 0) & (o < fade), (o + 0.5) / fade).otherwise(F.lit(1.0))
    weight = F.when(o >= size, 1 - (o - size + 0.5) / fade).otherwise(rising)
    return copies.groupBy("track", "ix").agg(F.sum(F.col("y") * weight).alias("y"))


def interpolated(points: DataFrame, anchors: DataFrame, key: str, at: str, value: str, cell: int) -> DataFrame:
    """``points`` with ``value``, linear between the anchors around; beyond the first or last anchor, its value.

    As-of in two levels: inside a time cell by a window over both sides; across cells by the last and first anchor of
    each cell, carried over the few rows that describe the cells.
    """
    b = F.floor(F.col(at) / cell)
    p = points.withColumns({"_b": b, "_t": F.lit(None).cast("long"), "_v": F.lit(None).cast("double"), "_p": F.lit(True)})
    a = anchors.select(key, at, *[F.lit(None).cast(t).alias(c) for c, t in points.dtypes if c not in (key, at)], b.alias("_b"), F.col(at).alias("_t"), F.col(value).cast("double").alias("_v"), F.lit(False).alias("_p"))
    both = p.unionByName(a)
    cells = both.groupBy(key, "_b").agg(F.max_by(F.struct("_t", "_v"), "_t").alias("_last"), F.min_by(F.struct("_t", "_v"), "_t").alias("_first"))
    w = Window.partitionBy(key).orderBy("_b")
    cells = cells.select(key, "_b", F.last("_last", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.first("_first", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    inside = Window.partitionBy(key, "_b").orderBy(at)
    anchor = F.when(~F.col("_p"), F.struct("_t", "_v"))
    near = both.join(cells, [key, "_b"]).withColumns({
        "_l": F.coalesce(F.last(anchor, True).over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)), "_before"),
        "_r": F.coalesce(F.first(anchor, True).over(inside.rangeBetween(Window.currentRow, Window.unboundedFollowing)), "_after"),
    })
    l, r = F.col("_l"), F.col("_r")
    line = l["_v"] + (r["_v"] - l["_v"]) * ((F.col(at) - l["_t"]) / (r["_t"] - l["_t"]))
    out = F.when(l["_v"].isNull(), r["_v"]).when(r["_v"].isNull() | (r["_t"] == l["_t"]), l["_v"]).otherwise(line)
    return near.where("_p").withColumn(value, out).drop("_b", "_t", "_v", "_p", "_before", "_after", "_l", "_r")


def count_within(points: DataFrame, events: DataFrame, ident: str, at: str, reach: int, cell: int) -> DataFrame:
    """ident, near: how many events lie within ``reach`` of each point (points that aren't events themselves).

    No pair is ever made: the count is the events up to the end of a point's reach less those before its beginning.  Both
    are running counts over instants (what falls on one instant is counted before), in three levels: over groups of time
    cells, over the cells of a group, and inside a cell.
    """
    ends = F.array(F.struct((F.col(at) + reach).alias("_at"), F.lit(1).alias("_sign")), F.struct((F.col(at) - reach - 1).alias("_at"), F.lit(-1).alias("_sign")))
    asked = layout.cut(points.select(ident, F.explode(ends).alias("_e")).select(ident, "_e.*"))
    moments = events.select(F.col(at).alias("_at"), F.lit(1).alias("_one")).unionByName(asked.select("_at", F.lit(0).alias("_one")))
    moments = layout.cut(moments.groupBy("_at").agg(F.sum("_one").alias("_one")).withColumn("_b", F.floor(F.col("_at") / cell)).withColumn("_c", F.floor(F.col("_b") / CELLS)))

    def start(df: DataFrame, within: list[str], by: str, name: str) -> DataFrame:
        before = Window.partitionBy(*(within or [F.lit(0)])).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        sums = df.groupBy(*within, by).agg(F.sum("_one").alias("_n"))
        return sums.select(*within, by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(name))

    inside = Window.partitionBy("_c", "_b").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = moments.join(start(moments, ["_c"], "_b", "_s1"), ["_c", "_b"]).join(start(moments, [], "_c", "_s0"), "_c")
    upto = known.select("_at", (F.col("_s0") + F.col("_s1") + F.sum("_one").over(inside)).alias("_upto"))
    return asked.join(upto, "_at").groupBy(ident).agg(F.sum(F.col("_sign") * F.col("_upto")).alias("near"))


def rises(df: DataFrame, keys: list[str], ix: str, value: str) -> DataFrame:
    """keys, last (largest whole hundredth) and rises: how many rows exceed every one before them."""
    b = df.withColumn("_b", F.floor(F.col(ix) / BLOCK))
    tops = b.groupBy(*keys, "_b").agg(F.max(value).alias("_m"))
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*keys, "_b", F.max("_m").over(w).alias("_before"))
    inside = Window.partitionBy(*keys, "_b").orderBy(ix).rowsBetween(Window.unboundedPreceding, -1)
    seen = b.join(tops, [*keys, "_b"]).withColumn("_top", F.greatest(F.col("_before"), F.max(value).over(inside)))
    return seen.groupBy(*keys).agg(F.max(F.floor(F.col(value) * 100).cast("int")).alias("last"), F.count_if(F.col(value) > F.col("_top")).alias("rises"))
