"""Thresholds from judged readings, floors from pairs, and models tested across groups."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.operators import layout


def derived_gates(gates: DataFrame, floors: DataFrame, judged: DataFrame, multiple: float = 3.0, gap_floors: float = 2.0) -> DataFrame:
    """gate, threshold, source, n_verdicts for gates (gate, metric, op, threshold) from floors (metric, spread) and judged readings
    (gate, side, value: good or bad).

    Halfway between the worst good and the best bad reading where they lie more than ``gap_floors`` spreads apart
    (``known ordering``); else, where a good reading fails the given threshold, ``multiple`` spreads past the worst good one
    (``known good bound``); else ``multiple`` spreads from nought, but never stricter than the given threshold
    (``floor``).  Only verdicts tighten a gate.  A gate without a threshold or a floor gets none; ``op`` is <= or >=.
    """
    upper = F.col("op") == "<="
    sides = judged.where(F.col("value").isNotNull()).groupBy("gate").agg(
        *[fn(F.when(F.col("side") == s, F.col("value"))).alias(f"{s}_{k}") for s in ("good", "bad") for k, fn in (("min", F.min), ("max", F.max), ("n", F.count))]
    )
    g = gates.where(F.col("threshold").isNotNull()).join(floors.where(F.col("spread").isNotNull()), "metric").join(sides, "gate", "left")
    worst_good, best_bad = F.when(upper, F.col("good_max")).otherwise(F.col("good_min")), F.when(upper, F.col("bad_min")).otherwise(F.col("bad_max"))
    gap = F.when(upper, best_bad - worst_good).otherwise(worst_good - best_bad)
    ordered = F.coalesce(gap > gap_floors * F.col("spread"), F.lit(False))
    fails = F.coalesce(F.when(upper, worst_good > F.col("threshold")).otherwise(worst_good < F.col("threshold")), F.lit(False))
    past = F.when(upper, multiple * F.col("spread")).otherwise(-multiple * F.col("spread"))
    loose = F.when(F.abs(past) > F.abs("threshold"), past).otherwise(F.col("threshold"))
    threshold = F.when(ordered, (worst_good + best_bad) / 2).when(fails, worst_good + past).otherwise(loose)
    source = F.when(ordered, "known ordering").when(fails, "known good bound").otherwise("floor")
    n = F.when(ordered, F.col("good_n") + F.col("bad_n")).when(fails, F.col("good_n")).otherwise(0)
    return g.select("gate", threshold.cast("double").alias("threshold"), source.alias("source"), n.cast("long").alias("n_verdicts"))


def pair_floor(vectors: DataFrame, key: str, vec_id: str = "vec_id", embedding: str = "embedding", partners: int = 16, p: float = 0.1, seed: int = 0) -> DataFrame:
    """key, n, pairs, floor: the ``p`` quantile of the cosines of pairs within each group.

    The rows of a group stand in the order of a hash of their id, and each meets the next ``partners``: all pairs of a
    group of up to partners + 1 rows, a seeded choice of ``partners`` pairs a row in larger ones, so a hot group costs what its
    rows cost.  Vectors that are null, zero or of another length than their partner give no cosine.
    """
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    order = F.md5(F.concat_ws(":", F.col(vec_id).cast("string"), F.lit(str(seed))))
    rows = vectors.where(F.col(key).isNotNull() & F.col(embedding).isNotNull()).select(F.col(key).alias("key"), order.alias("o"), F.col(vec_id).alias("id"), v.alias("v"))
    placed = layout.cut(layout.numbered(rows, ["key"], ["o", "id"], F.substring("o", 1, 3)))
    norm = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    left = placed.select("key", "v", F.explode(F.sequence(F.col("ix") + 1, F.col("ix") + partners)).alias("ix"))
    both = left.join(placed.select("key", "ix", F.col("v").alias("u")), ["key", "ix"]).where(F.size("u") == F.size("v"))
    dot = F.aggregate(F.zip_with("u", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    cosines = layout.cut(both.select("key", F.try_divide(dot, norm("u") * norm("v")).alias("c")).where(F.col("c").isNotNull() & ~F.isnan("c")))
    counts = placed.groupBy("key").agg(F.count("*").alias("n")).join(cosines.groupBy("key").agg(F.count("*").alias("pairs")), "key")
    return counts.join(layout.quantiles(cosines, ["key"], "c", floor=p), "key").withColumnRenamed("key", key)


def cross_validated(pairs: DataFrame, names: Sequence[str], group: Column | str, folds: int = 5, l2: float = 0.1, steps: int = 25, close: float = 1e-10) -> DataFrame:
    """fold, n, log_loss, base_loss, weights (array) of logistic fits of ``y`` (0 to 1) that each leave one fold out.

    A fold holds whole groups, chosen by a hash, so that no group is on both sides.  All fits take a Newton step together, in
    one aggregation over all rows; they stop when no weight moves by more than ``close``.  Differences are scaled by
    their root mean squares; null ones count as 0, rows with a null ``y`` take no part, and base_loss is that of an even guess.
    """
    d = len(names)
    known = pairs.where(F.col("y").isNotNull())
    scales = [r or 1.0 for r in known.agg(*[F.sqrt(F.avg(F.coalesce(F.col(n), F.lit(0.0)) ** 2)) for n in names]).head()]
    fold = F.pmod(F.xxhash64(group), F.lit(folds)).cast("int")
    x = layout.cut(known.select(fold.alias("fold"), F.col("y").cast("double").alias("y"), *[(F.coalesce(F.col(n), F.lit(0.0)) / s).alias(f"x{i}") for i, (n, s) in enumerate(zip(names, scales, strict=True))]))
    w = np.zeros((folds, d))
    chance = lambda k: 1 / (1 + F.exp(-sum((F.col(f"x{i}") * float(w[k, i]) for i in range(d)), F.lit(0.0))))
    for _ in range(steps):
        aggs = []
        for k in range(folds):
            p, there = chance(k), F.col("fold") != k
            aggs += [F.avg(F.when(there, (p - F.col("y")) * F.col(f"x{i}"))) for i in range(d)]
            aggs += [F.avg(F.when(there, p * (1 - p) * F.col(f"x{i}") * F.col(f"x{j}"))) for i in range(d) for j in range(i + 1)]
        got = np.array([v or 0.0 for v in x.agg(*aggs).head()]).reshape(folds, -1)
        moved = 0.0
        for k in range(folds):
            curve = np.zeros((d, d))
            curve[np.tril_indices(d)] = got[k, d:]
            curve = curve + np.tril(curve, -1).T + l2 * np.eye(d)
            step = np.linalg.solve(curve, got[k, :d] + l2 * w[k])
            w[k] -= step
            moved = max(moved, float(np.abs(step).max(initial=0.0)))
        if moved <= close:
            break
    own = F.element_at(F.array(*[chance(k) for k in range(folds)]), F.col("fold") + 1)
    loss = -(F.col("y") * F.log(F.greatest(own, F.lit(1e-300))) + (1 - F.col("y")) * F.log(F.greatest(1 - own, F.lit(1e-300))))
    weights = F.element_at(F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in w]), F.col("fold") + 1)
    out = x.groupBy("fold").agg(F.count("*").alias("n"), F.avg(loss).alias("log_loss"))
    return out.select("fold", "n", "log_loss", F.log(F.lit(2.0)).alias("base_loss"), weights.alias("weights"))
