"""Scores of candidates against sources: summaries, gates, distances, ranks, rewards and tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.functions.levels import finite
from sigloom.operators import layout


#: Rows of a dimension at most.
MOST = 1000


def with_each(df: DataFrame, dimension: DataFrame) -> DataFrame:
    """``df`` with every row of a small dimension (gates, readings of a grid), which becomes a literal list in the plan.

    A dimension of more than ``MOST`` rows is refused.
    """
    kinds, rows = dict(dimension.dtypes), dimension.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"a dimension has {MOST} rows at most")
    items = [F.struct(*[F.lit(r[c]).cast(t).alias(c) for c, t in kinds.items()]) for r in rows]
    if not items:
        return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()]).limit(0)
    return df.withColumn("_item", F.explode(F.array(*items))).select(*df.columns, "_item.*")


def deltas(readings: DataFrame) -> DataFrame:
    """``readings`` with delta, where both sides are finite."""
    return readings.where(finite(F.col("src")) & finite(F.col("out"))).withColumn("delta", F.col("out") - F.col("src"))


def summarise(deltas: DataFrame, specs: DataFrame) -> DataFrame:
    """tape, candidate, metric, side, median, tail, p95, top, n over the routes that a metric is read on.

    The tail is the bad end by the metric's direction: the 10 % quantile where higher is better, the 90 % one where
    lower is, and the one farther from the target (of equals the 90 % one) where either way is worse.
    """
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("x")) for s, c in (("delta", "delta"), ("src", "src"), ("out", "out"))])
    routed = deltas.join(F.broadcast(specs), "metric").where(F.array_contains("routes", F.col("route")))
    melted = routed.select("tape", "candidate", "metric", "better", "target", F.explode(sides).alias("s")).select("tape", "candidate", "metric", "better", "target", "s.*")
    keys = ["tape", "candidate", "metric", "side"]
    melted = layout.cut(layout.counted(melted, [*keys, "better", "target"], "x"))
    q = layout.quantiles(melted, keys, "x", "_c", p10=0.1, median=0.5, p90=0.9, p95=0.95)
    more = melted.groupBy(*keys).agg(F.max("x").alias("top"), F.sum("_c").alias("n"), F.first("better").alias("better"), F.first("target").alias("target"))
    far = F.when(F.abs(F.col("p10") - F.col("target")) > F.abs(F.col("p90") - F.col("target")), F.col("p10")).otherwise(F.col("p90"))
    tail = F.when(F.col("better") == "higher", F.col("p10")).when(F.col("better") == "lower", F.col("p90")).otherwise(far)
    return q.join(more, keys).select(*keys, "median", tail.alias("tail"), "p95", "top", "n")


def verdicts(summary: DataFrame, gates: DataFrame) -> DataFrame:
    """A verdict of every gate on every candidate: passed, failed, or skipped where the reading is missing."""
    spine = with_each(summary.select("tape", "candidate").distinct(), gates)
    s = spine.join(summary.select("tape", "candidate", "metric", "side", "median", "tail"), ["tape", "candidate", "metric", "side"], "left")
    value = F.when(F.col("stat") == "tail", F.col("tail")).otherwise(F.col("median"))
    s = s.withColumn("value", value)
    good = F.when(F.col("op") == "<=", F.col("value") <= F.col("threshold")).when(F.col("op") == ">=", F.col("value") >= F.col("threshold")).otherwise(F.abs("value") <= F.col("threshold"))
    status = F.when(F.col("value").isNull(), "skipped").when(good, "passed").otherwise("failed")
    return s.select("tape", "candidate", "gate", "severity", "value", "threshold", status.alias("status"))


def overlaid(gates: DataFrame, fresh: DataFrame) -> DataFrame:
    """Gates with fresh thresholds (gate, fresh, verdicted); one that nobody judged may loosen a gate, never tighten it."""
    looser = F.when(F.col("op") == ">=", F.least("threshold", "fresh")).otherwise(F.greatest("threshold", "fresh"))
    new = F.when(F.col("fresh").isNull(), F.col("threshold")).when(F.col("verdicted"), F.col("fresh")).otherwise(looser)
    return gates.join(fresh, "gate", "left").withColumn("threshold", new).drop("fresh", "verdicted")


def flattened(summary: DataFrame) -> DataFrame:
    """tape, candidate, reading (metric.side.stat), value."""
    stats = F.array(F.struct(F.lit("median").alias("stat"), F.col("median").alias("value")), F.struct(F.lit("tail").alias("stat"), F.col("tail").alias("value")))
    return summary.select("tape", "candidate", "metric", "side", F.explode(stats).alias("s")).select("tape", "candidate", F.concat_ws(".", "metric", "side", "s.stat").alias("reading"), "s.value")


def distances(flat: DataFrame, grid: DataFrame) -> DataFrame:
    """Every candidate on every reading of the grid: raw, its weighted distance from the target, and its tie band.

    Beyond the dead zone a distance counts in units of the scale; within the tie the band is what noise can explain.
    """
    spine = with_each(flat.select("tape", "candidate").distinct(), grid)
    s = spine.join(flat, ["tape", "candidate", "reading"], "left")
    off = F.abs(F.col("value") - F.col("target"))
    raw = F.col("weight") * F.greatest(F.lit(0.0), off - F.col("dead_zone")) / F.col("scale")
    band = F.col("weight") * F.least(F.col("tie"), F.greatest(F.lit(0.0), off + F.col("tie") - F.col("dead_zone"))) / F.col("scale")
    return s.withColumns({"raw": F.when(F.col("value").isNotNull(), raw), "band": F.when(F.col("value").isNotNull(), band)})


def fill_missing(dist: DataFrame) -> DataFrame:
    """``dist`` with dist: a reading that a candidate lost is charged the worst of its tape plus the weight."""
    worst = dist.groupBy("tape", "reading").agg(F.max("raw").alias("_worst"))
    return dist.join(worst, ["tape", "reading"]).withColumn("dist", F.coalesce("raw", F.col("_worst") + F.col("weight"))).drop("_worst")


def pair_points(filled: DataFrame) -> DataFrame:
    """tape, candidate, other, family, points: 1, 0.5 or 0 by the summed gap against the summed band.

    Pairs are those of the candidates of one tape on one reading: few, as a tape has few candidates.
    """
    a, b = filled.alias("a"), filled.alias("b")
    j = a.join(b, (F.col("a.tape") == F.col("b.tape")) & (F.col("a.reading") == F.col("b.reading")) & (F.col("a.candidate") != F.col("b.candidate")))
    g = j.groupBy(F.col("a.tape"), F.col("a.candidate"), F.col("b.candidate").alias("other"), F.col("a.family")).agg(F.sum(F.col("a.dist") - F.col("b.dist")).alias("gap"), F.sum(F.greatest("a.band", "b.band")).alias("band"))
    return g.select("tape", "candidate", "other", "family", F.when(F.abs("gap") <= F.col("band"), 0.5).when(F.col("gap") < 0, 1.0).otherwise(0.0).alias("points"))


def win_rates(points: DataFrame) -> DataFrame:
    return points.groupBy("tape", "candidate", "family").agg(F.avg("points").alias("rate"))


def rewards(rates: DataFrame, trips: DataFrame, cap: float = 0.25) -> DataFrame:
    """tape, candidate, worst_family, status, reward: the rate of the worst family, capped where a constraint tripped."""
    w = rates.groupBy("tape", "candidate").agg(F.min_by("family", F.struct("rate", "family")).alias("worst_family"), F.min("rate").alias("rate")).join(trips, ["tape", "candidate"])
    status = F.when(F.col("tripped"), "capped").when(F.col("rate") == 0.5, "tie").otherwise("ok")
    return w.select("tape", "candidate", "worst_family", status.alias("status"), F.when(F.col("tripped"), F.least("rate", F.lit(cap))).otherwise(F.col("rate")).alias("reward"))


def banded_ranks(scores: DataFrame, keys: list[str], value: str, band: float) -> DataFrame:
    """Rank of each candidate: 1, plus one for each that is better beyond the band, plus a half for each within it."""
    a, b = scores.select(*keys, "candidate", F.col(value).alias("_v")), scores.select(*keys, F.col("candidate").alias("_o"), F.col(value).alias("_w"))
    ahead = F.when(F.col("_o") == F.col("candidate"), 0.0).when(F.abs(F.col("_v") - F.col("_w")) <= band, 0.5).when(F.col("_w") < F.col("_v"), 1.0).otherwise(0.0)
    return a.join(b, keys).groupBy(*keys, "candidate").agg(F.round(1 + F.sum(ahead), 2).alias("rank"))


def tie_buckets(scores: DataFrame, tie: float) -> DataFrame:
    """Clusters along the scores of a tape, each anchored on its lowest: a fold over the few sorted candidates of a tape."""
    items = scores.groupBy("tape").agg(F.array_sort(F.collect_list(F.struct(F.col("total"), F.col("candidate")))).alias("items"))
    start = F.struct(F.lit(float("-inf")).alias("anchor"), F.lit(0).alias("bucket"), F.expr("CAST(array() AS ARRAY<STRUCT<candidate: STRING, bucket: INT>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        same = x["total"] - acc["anchor"] <= tie
        bucket = F.when(same, acc["bucket"]).otherwise(acc["bucket"] + 1)
        return F.struct(F.when(same, acc["anchor"]).otherwise(x["total"]).alias("anchor"), bucket.alias("bucket"), F.concat(acc["out"], F.array(F.struct(x["candidate"].alias("candidate"), bucket.alias("bucket")))).alias("out"))

    return items.select("tape", F.explode(F.aggregate("items", start, step)["out"]).alias("o")).select("tape", "o.*")


def average_ranks(scores: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Ranks in which ties share their average; missing values come last."""
    w = Window.partitionBy(*keys)
    return scores.withColumn("rank", F.rank().over(w.orderBy(F.col(value).asc_nulls_last())) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2.0)


def moves(dist: DataFrame, incumbent: str) -> DataFrame:
    """mine, theirs and move of every candidate's reading against the incumbent's."""
    i = dist.where(F.col("candidate") == incumbent).select("tape", "reading", F.col("raw").alias("theirs"))
    return dist.where(F.col("candidate") != incumbent).join(i, ["tape", "reading"]).select("tape", "candidate", "reading", "ix", F.col("raw").alias("mine"), "theirs", (F.col("raw") - F.col("theirs")).alias("move"))


def trips(moves: DataFrame, max_move: float, bound: float | None = None) -> DataFrame:
    """Whether a reading moved too far for the worse; with a bound, only past it.  A lost reading trips."""
    if bound is None:
        far = F.col("move") > max_move
    else:
        past = F.col("mine") - bound
        far = (F.col("move") > 0) & (past > 0) & (F.greatest("move", past) > max_move)
    gone = F.col("mine").isNull() & F.col("theirs").isNotNull()
    return moves.select("tape", "candidate", "reading", F.when(gone, True).otherwise(F.coalesce(far, F.lit(False))).alias("trips"))


def sign_tests(moves: DataFrame, still: float) -> DataFrame:
    """candidate, reading, worse, better and the one-sided exact p: chance of so many worse tapes among those that moved."""
    s = moves.groupBy("candidate", "reading").agg(F.count_if(F.col("move") > still).alias("worse"), F.count_if(F.col("move") < -still).alias("better"))
    n = F.col("worse") + F.col("better")

    def choose(k: Column) -> Column:
        return F.when(k == 0, F.lit(1.0)).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), F.lit(1.0), lambda a, i: a * (n - i + 1) / i))

    p = F.aggregate(F.transform(F.sequence(F.col("worse"), n), lambda k: choose(k) / F.pow(F.lit(2.0), n)), F.lit(0.0), lambda a, x: a + x)
    return s.withColumn("p", F.when(n == 0, F.lit(1.0)).otherwise(p))


def holm(tests: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    """Step-down over the ordered p values of a family: rejected until the first miss."""
    w = Window.partitionBy(*keys).orderBy("p", "reading")
    o = tests.withColumns({"i": F.row_number().over(w), "m": F.count("*").over(Window.partitionBy(*keys))})
    missed = F.max((F.col("p") > alpha / (F.col("m") - F.col("i") + 1)).cast("int")).over(Window.partitionBy(*keys).orderBy("i"))
    return o.withColumn("missed", missed).select(*keys, "reading", "i", (F.col("missed") == 0).alias("rejected"))


def over_cap(entries: DataFrame, keys: list[str], order: list, bucket: Column, size: str, cap: float) -> DataFrame:
    """Entries beyond the cap when kept in ``order``: running sums in two levels, of buckets (latest first) and inside them."""
    b = entries.withColumn("_b", bucket)
    sums = b.groupBy(*keys, "_b").agg(F.sum(size).alias("_s"))
    before = Window.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    return b.join(sums, [*keys, "_b"]).withColumn("_kept", F.col("_start") + F.sum(size).over(inside)).where(F.col("_kept") > cap).drop("_b", "_start", "_kept")
