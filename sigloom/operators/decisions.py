"""What may win: thresholds of each tape, protected gates, constraints, vetoes, refused settings, and rewards under them.

Readings come flat, as (tape, candidate, reading, value); a value that is null, NaN or infinite counts as lost.  Rules are
dimensions of a few rows.  Only a tape's own few candidates ever meet each other.
"""

from __future__ import annotations

import math
from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions.levels import finite
from sigloom.operators import layout, scoring

#: What a candidate gets that is out, or that can't be heard apart, and one without a rated reading.
OUT, NEUTRAL = 0.0, 0.5
#: Level of the family of tests, share of clips that must pass the limit.
ALPHA, MOVED = 0.05, 1 / 3
#: Targets of the loudness stage: level and true peak, range, and the length (s) below which nothing can keep it from being linear.
TARGET_I, TARGET_TP, TARGET_LRA, SHORT_S = -16.0, -1.0, 20.0, 3.0


def rollup(readings: DataFrame) -> DataFrame:
    """candidate, reading, tape, median, p10, n: over all (tape null, whole true), and of each tape (without p10)."""
    levels = F.explode(F.array(F.struct(F.lit(True).alias("whole"), F.lit(None).cast(readings.schema["tape"].dataType).alias("tape")), F.struct(F.lit(False).alias("whole"), F.col("tape").alias("tape"))))
    m = layout.counted(readings.where(finite(F.col("value"))), ["candidate", "reading", "tape"], "value")  # equal values are one row before they are doubled
    m = layout.cut(m.select("candidate", "reading", "value", "_c", levels.alias("l")).select("candidate", "reading", "value", "_c", "l.*"))
    keys = ["candidate", "reading", "whole", "tape"]
    n = m.groupBy(F.struct(*keys).alias("_k")).agg(F.sum("_c").alias("n"))
    q = layout.quantiles(m, keys, "value", "_c", median=0.5, p10=0.1).select(F.struct(*keys).alias("_k"), "median", "p10")
    return q.join(n, "_k").select("_k.*", "median", F.when(F.col("_k.whole"), F.col("p10")).alias("p10"), "n")


def excused(failures: DataFrame, baseline: str, allowed: int = 0) -> DataFrame:
    """candidate, failed, baseline, vetoed from (candidate, excerpt, failed: bool): vetoed are those that fail on more excerpts than
    are allowed and than the baseline does, whose own engine may fail on a tape's lead-in whatever is done."""
    f = failures.groupBy("candidate").agg(F.count_distinct(F.when(F.col("failed"), F.col("excerpt"))).alias("failed"))
    b = f.where(F.col("candidate") == baseline).agg(F.coalesce(F.max("failed"), F.lit(0)).alias("baseline"))
    return scoring.with_each(f, b).withColumn("vetoed", F.col("failed") > F.greatest(F.lit(allowed), F.col("baseline")))


def threshold_of(threshold: Column, floor: Column) -> Column:
    """A gate's threshold as a number: a number as it is, "floor", "floor-x" or "floor+x" from the tape's own floor."""
    step = F.regexp_replace(threshold, "^floor", "")
    return F.when(threshold.startswith("floor"), floor + F.when(step == "", 0.0).otherwise(step.cast("double"))).otherwise(threshold.cast("double"))


def floor_verdicts(summary: DataFrame, gates: DataFrame, floors: DataFrame) -> DataFrame:
    """``scoring.verdicts`` of gates whose thresholds are texts, some relative to the floor of a tape (tape, floor): skipped where
    the reading or the floor is not known."""
    s = scoring.verdicts(summary, gates).join(floors.select("tape", "floor"), "tape", "left")
    s = s.join(F.broadcast(gates.select("gate", "op")), "gate").withColumn("threshold", threshold_of(F.col("threshold"), F.col("floor")))
    good = F.when(F.col("op") == "<=", F.col("value") <= F.col("threshold")).when(F.col("op") == ">=", F.col("value") >= F.col("threshold")).otherwise(F.abs("value") <= F.col("threshold"))
    known = finite(F.col("value")) & F.col("threshold").isNotNull()
    return s.select("tape", "candidate", "gate", "severity", "value", "threshold", F.when(~known, "skipped").when(good, "passed").otherwise("failed").alias("status"))


def protected(gates: DataFrame, fresh: DataFrame, fixed: Collection[str] = (), display: Collection[str] = (), retired: Collection[str] = ()) -> DataFrame:
    """``gates`` (gate, metric, op, threshold, severity) with the entries of ``fresh`` (the same, n_verdicts and source) over them.

    A null field leaves what is there.  A gate of ``fixed`` stays whole, one of ``display`` keeps its severity; a name of ``retired``
    that the gates lack is left out, other new names are added.  An entry whose source is "floor" and that no verdict tested
    never makes a gate stricter and doesn't count as calibrated; one with any other source does.
    """
    b, f = gates.select(*[F.col(c).alias(f"_b_{c}") for c in ("gate", "metric", "op", "threshold", "severity")]), fresh.withColumnRenamed("gate", "_f_gate")
    j = b.join(f, F.col("_b_gate") == F.col("_f_gate"), "full_outer")
    known, name = F.col("_b_gate").isNotNull(), F.coalesce("_b_gate", "_f_gate")
    whole = known & name.isin(*fixed) if fixed else F.lit(False)
    shown = known & name.isin(*display) if display else F.lit(False)
    op = F.coalesce("op", "_b_op")
    untested = F.coalesce((F.col("source") == "floor") & (F.coalesce("n_verdicts", F.lit(0)) == 0), F.lit(False))
    looser = F.when(op == "<=", F.greatest("threshold", "_b_threshold")).when(op == ">=", F.least("threshold", "_b_threshold")).otherwise(F.greatest(F.abs("threshold"), F.abs("_b_threshold")))
    threshold = F.when(known & untested & F.col("_b_threshold").isNotNull() & F.col("threshold").isNotNull(), looser).otherwise(F.coalesce("threshold", "_b_threshold"))
    if retired:
        j = j.where(known | ~name.isin(*retired))
    return j.select(
        name.alias("gate"), F.when(whole, F.col("_b_metric")).otherwise(F.coalesce("metric", "_b_metric")).alias("metric"), F.when(whole, F.col("_b_op")).otherwise(op).alias("op"),
        F.when(whole, F.col("_b_threshold")).otherwise(threshold).alias("threshold"), F.when(whole | shown, F.col("_b_severity")).otherwise(F.coalesce("severity", "_b_severity")).alias("severity"),
        (~whole & F.coalesce(F.col("source").isNotNull() & ~untested, F.lit(False))).alias("calibrated"),
    )


def against(flat: DataFrame, incumbent: str, rules: DataFrame) -> DataFrame:
    """tape, candidate, the rule's columns, value, theirs and step (how far for the worse; null where lost), of every reading that the
    incumbent has and a rule (reading, worse: up or down, ...) names."""
    theirs = flat.where((F.col("candidate") == incumbent) & finite(F.col("value"))).select("tape", "reading", F.col("value").alias("theirs"))
    spine = scoring.with_each(flat.where(F.col("candidate") != incumbent).select("tape", "candidate").distinct(), rules)
    s = spine.join(theirs, ["tape", "reading"]).join(flat.select("tape", "candidate", "reading", F.when(finite(F.col("value")), F.col("value")).alias("value")), ["tape", "candidate", "reading"], "left")
    return s.withColumn("step", F.when(F.col("worse") == "up", F.col("value") - F.col("theirs")).otherwise(F.col("theirs") - F.col("value")))


def limited(rules: DataFrame, floors: DataFrame) -> DataFrame:
    """Rules of vetoes (reading, worse, multiple) with limit, so many benign floors (reading, floor) of their reading.

    A rule whose reading has no floor, or none above nought, is an error: a limit of nought would veto any step.
    """
    known = rules.join(floors.select("reading", "floor"), "reading", "left")
    bad = F.raise_error(F.concat(F.lit("no floor above nought for the veto of "), F.col("reading")))
    return known.withColumn("limit", F.when(finite(F.col("floor")) & (F.col("floor") > 0), F.col("multiple") * F.col("floor")).otherwise(bad.cast("double"))).drop("floor")


def vetoed(steps: DataFrame) -> DataFrame:
    """tape, candidate, reading, vetoed: a step (of ``against``, with limit) beyond its limit, or a lost reading."""
    return steps.select("tape", "candidate", "reading", F.coalesce(F.col("step") > F.col("limit"), F.lit(True)).alias("vetoed"))


def family_vetoes(steps: DataFrame, jitter: float = 0.0, alpha: float = ALPHA, share: float = MOVED) -> DataFrame:
    """candidate, reading, clips, worse, better, past, p, vetoed: vetoes that hold over all tapes of a candidate together.

    A reading trips where at least ``share`` of its clips pass the limit and, of the candidate's readings taken as one family, Holm's
    procedure rejects its sign test; with too few clips for any test to reach that, where it is worse on every clip.
    """
    lost = F.col("step").isNull()
    g = steps.groupBy("candidate", "reading").agg(F.count("*").alias("clips"), F.count_if(lost | (F.col("step") > jitter)).alias("worse"), F.count_if(F.col("step") < -jitter).alias("better"), F.count_if(lost | (F.col("step") > F.col("limit"))).alias("past"))
    rules = steps.select("reading").distinct().agg(F.count("*").alias("rules"))
    tests = scoring.sign_tests(steps.select("candidate", "reading", F.coalesce("step", F.lit(float("inf"))).alias("move")), jitter).select("candidate", "reading", "p")
    rejected = scoring.holm(tests, ["candidate"], alpha).select("candidate", "reading", "rejected")
    s = scoring.with_each(g.join(tests, ["candidate", "reading"]).join(rejected, ["candidate", "reading"]), rules)
    enough = F.col("past") >= F.ceil(F.col("clips") * share)
    resolves = F.col("clips") >= F.ceil(F.log2(F.greatest(F.col("rules"), F.lit(1)) / alpha))
    return s.withColumn("vetoed", enough & F.when(resolves, F.col("rejected")).otherwise(F.col("worse") == F.col("clips"))).drop("rules", "rejected")


def refused(settings: DataFrame, incumbent: DataFrame, rules: DataFrame) -> DataFrame:
    """candidate, key, value, bound, side of the settings (candidate, key, value) that step to a bound which was rejected by ear.

    A rule (key, bound, side: 1 above, -1 below) refuses a value at the bound or past it that heads that way from the incumbent's
    (key, value); a key the incumbent leaves out heads any way.
    """
    s = settings.where(finite(F.col("value"))).join(rules, "key").join(incumbent.select("key", F.col("value").alias("_now")), "key", "left")
    heads = ~finite(F.col("_now")) | (F.col("side") * (F.col("value") - F.col("_now")) > 0)
    return s.where(heads & (F.col("side") * (F.col("value") - F.col("bound")) >= 0)).select("candidate", "key", "value", "bound", "side")


#: Checks of a candidate, each true or false; those that put it out.
CHECKS = ("hard_gate", "listener_flag", "inaudible", "verdict_reversal", "learned_veto", "dsp_guard")
PUT_OUT = ("hard_gate", "verdict_reversal", "learned_veto", "dsp_guard")


def status(out: Column, inaudible: Column, flagged: Column) -> Column:
    return F.when(out, "excluded").when(inaudible, "tie").when(flagged, "capped").otherwise("ok")


def statuses(checks: DataFrame) -> DataFrame:
    """tape, candidate, status of (tape, candidate, ``CHECKS``): excluded, tie, capped or ok; a check that is null didn't trip."""
    on = {c: F.coalesce(F.col(c), F.lit(False)) for c in CHECKS}
    out = on[PUT_OUT[0]]
    for c in PUT_OUT[1:]:
        out = out | on[c]
    return checks.select("tape", "candidate", status(out, on["inaudible"], on["listener_flag"]).alias("status"))


def rewards(dist: DataFrame, statuses: DataFrame) -> DataFrame:
    """tape, candidate, status, family, reward, may_win: each candidate's rate of wins in its worst family, under its status.

    ``dist`` is that of ``scoring.distances``.  Only candidates that are ok or capped are compared, and lost readings are charged among
    them alone.  One that is excluded gets nothing, a tie or one that nothing rates (``unrated``) the neutral reward; a capped
    one gets no more than that, and only one that is ok may win.
    """
    known = statuses.where(F.col("status").isin("ok", "capped")).select("tape", "candidate")
    compared = layout.cut(scoring.fill_missing(dist.join(known, ["tape", "candidate"], "left_semi")).where(F.col("dist").isNotNull()))
    rates = scoring.win_rates(scoring.pair_points(compared))
    worst = rates.groupBy("tape", "candidate").agg(F.min_by("family", F.struct("rate", "family")).alias("family"), F.min("rate").alias("rate"))
    j = statuses.join(worst, ["tape", "candidate"], "left")
    live = F.col("status").isin("ok", "capped")
    shown = F.when(live & F.col("rate").isNull(), "unrated").otherwise(F.col("status"))
    reward = F.when(F.col("status") == "excluded", OUT).when(~live | F.col("rate").isNull(), NEUTRAL).when(F.col("status") == "capped", F.least("rate", F.lit(NEUTRAL))).otherwise(F.col("rate"))
    return j.select("tape", "candidate", shown.alias("status"), F.when(live, F.col("family")).alias("family"), reward.alias("reward"), ((F.col("status") == "ok") & F.col("rate").isNotNull()).alias("may_win"))


def linear_blockers(loudness: Column, peak: Column, lra: Column, seconds: Column | None = None, target_lra: float = TARGET_LRA) -> Column:
    """Why a loudness stage can't stay linear: an array of "unreadable", or of "range" and "true peak"; empty where it can.

    Ranges above the target and peaks (dB) that the gain to the target would lift above theirs do it; programmes of less than
    ``SHORT_S`` seconds have no blockers.
    """
    readable = finite(loudness) & finite(peak) & finite(lra) & (loudness != 0) & (lra != 0)
    why = F.array_compact(F.array(F.when(lra > target_lra, F.lit("range")), F.when(peak + (TARGET_I - loudness) > TARGET_TP, F.lit("true peak"))))
    found = F.when(F.coalesce(readable, F.lit(False)), why).otherwise(F.array(F.lit("unreadable")))
    if seconds is None:
        return found
    return F.when(F.coalesce((seconds > 0) & (seconds < SHORT_S), F.lit(False)), F.expr("CAST(array() AS ARRAY<STRING>)")).otherwise(found)


def stage(blockers: Column, loudness: Column, limiter: bool = True) -> Column:
    """What the loudness stage does: linear, limited (one gain, then a limiter, where the peak alone is in the way) or dynamic."""
    only_peak = (F.size(blockers) == 1) & F.array_contains(blockers, "true peak")
    return F.when(F.size(blockers) == 0, "linear").when(only_peak & F.lit(limiter) & finite(loudness), "limited").otherwise("dynamic")


def resolvable(rules: int, alpha: float = ALPHA) -> int:
    """The fewest clips on which a sign test can reach the first threshold of Holm's procedure over so many readings."""
    return math.ceil(math.log2(max(1, rules) / alpha))
