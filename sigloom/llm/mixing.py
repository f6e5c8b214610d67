"""Mixing sources to target weights by weighted fair queueing.

Each document of a source, in a shuffled order, gets a virtual finish time: the words its source has sent up to and
including it, divided by the source's target.  All sources then send at rates in proportion to their targets, so the
documents in order of finish time, cut where the total budget is used up, give every source its target.  A source
whose target exceeds its size is sent again, in the same order, after its last document.

Scale: no key is gathered.  Running sums come in two levels: sums per (source, bucket of the shuffle hash), running
sums over those few rows, and running sums inside a bucket; a source with a third of all rows is spread over its
buckets.  The cut is found from a histogram of finish times, and only the one bin that holds the cut is put in order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, word_count

#: Hexadecimal digits of the shuffle hash that make a bucket, and bins of the finish-time histogram.
BUCKET_DIGITS, BINS = 3, 2048
#: Sources whose rows are broadcast; with more of them, the joins with sources are left to Spark.
FEW_SOURCES = 100_000
#: Rows that are put in order in one task at most.
ORDERED_ROWS = 50_000
WEIGHTS = (5.0, 2.0, 1.0)


def targets(sizes: list[tuple[object, int]], weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> dict:
    """Target words of each source, from (source, size) pairs in their order; weights repeat.

    ``share`` of all words is split by weight; a target stops at ``most`` times its source's size and what is cut off
    is split again among the others by weight, until none is above.  With every source at its limit the rest is dropped.
    """
    w = {k: float(weights[i % len(weights)]) for i, (k, _) in enumerate(sizes)}
    limit = {k: most * n for k, n in sizes}
    left, open_w, out = share * sum(n for _, n in sizes), sum(w.values()), {}
    for k in sorted(w, key=lambda k: limit[k] / w[k]):  # the first to reach its limit comes first
        if left / open_w * w[k] > limit[k]:
            out[k] = limit[k]
            left, open_w = left - limit[k], open_w - w[k]
        else:
            out[k] = left / open_w * w[k]
    return out


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the text; null: 0) and the shuffle hash, which depends on id and text alone."""
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))
    return docs.select("doc_id", "source", word_count("text").alias("size"), key.alias("hash"))


def source_targets(rows: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, _src (its rank by code point, null last), source_size, target: one row per source, by way of the driver."""
    per = sorted(((r["source"], r["s"]) for r in rows.groupBy("source").agg(F.sum("size").alias("s")).collect()), key=lambda x: (x[0] is None, (x[0] or "").encode()))
    goal = targets(per, weights, share, most)
    return rows.sparkSession.createDataFrame([(k, i, int(s), round(float(goal[k]), 6)) for i, (k, s) in enumerate(per)], "source string, _src int, source_size long, target double")


def beside(sources: DataFrame, n: int) -> DataFrame:
    """``sources`` (a row per source) as the side of a join."""
    return F.broadcast(sources) if n <= FEW_SOURCES else sources


def queued(rows: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    """``rows`` with _src, source_size, target and _cum, the words of its source up to and including the row."""
    known = rows.withColumnRenamed("source", "_s").join(beside(sources, n), F.col("_s").eqNullSafe(F.col("source"))).drop("_s")
    known = known.withColumn("_bucket", F.substring("hash", 1, BUCKET_DIGITS))
    sums = known.groupBy("_src", "_bucket").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("_src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_src", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    # rows with one hash are exact repeats of one row: they share a finish time and are sent together
    inside = Window.partitionBy("_src", "_bucket").orderBy("hash").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return known.join(starts, ["_src", "_bucket"]).withColumn("_cum", F.col("_start") + F.sum("size").over(inside)).drop("_start", "_bucket")


def finish(turn) -> Column:
    """Virtual finish time of a row when it is sent for the ``turn``-th time, from 0."""
    return (turn * F.col("source_size") + F.col("_cum")).cast("double") / F.when(F.col("target") > 0, F.col("target"))


def cut_point(queue: DataFrame, budget: float, turns: int) -> tuple[float, int, str]:
    """The last (finish, _src, hash) whose words, with all that come before it, stay within ``budget``.

    The finish times are range-sorted step by step: a histogram (``BINS`` rows) goes through the driver and finds the
    bin that holds the cut; a bin of more than ``ORDERED_ROWS`` rows is looked at again in finer bins; the rows of the
    last bin are then added up in order.
    """
    sent = queue.where(F.col("size") > 0).withColumn("turn", F.explode(F.array(*[F.lit(i) for i in range(turns)])))
    sent = sent.select("_src", "hash", "size", finish(F.col("turn")).alias("finish"))
    used, low, width, inside = 0, 0.0, 2.0, sent.where(F.col("finish").isNotNull())
    while True:
        place = F.least(F.greatest(F.floor((F.col("finish") - low) / (width / BINS)), F.lit(0)), F.lit(BINS)).cast("int")  # the ends are open
        hist = {r["b"]: (r["s"], r["n"]) for r in inside.groupBy(place.alias("b")).agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()}
        for b in sorted(hist):
            if used + hist[b][0] > budget:
                break
            used += hist[b][0]
        else:
            return (float("inf"), 0, "")
        if hist[b][1] <= ORDERED_ROWS or b == BINS or width < 1e-9:
            break
        low, width, inside = low + b * (width / BINS), width / BINS, inside.where(place == b)  # too many to order in one task: look closer
    there = inside.where(place == b).groupBy("finish", "_src", "hash").agg(F.sum("size").alias("size"))
    ordered = Window.orderBy("finish", "_src", "hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = there.withColumn("upto", F.sum("size").over(ordered)).where(F.col("upto") + used <= budget).agg(F.max(F.struct("finish", "_src", "hash")).alias("m")).head()["m"]
    return tuple(best) if best else (low + b * (width / BINS), -1, "")


def planned(rows: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> tuple[DataFrame, list[Column], int]:
    """The queue, for each turn whether a row is sent in it, and the number of sources.  ``rows`` (of ``sized``) are read three times."""
    sources, turns = source_targets(rows, weights, share, most), math.ceil(most)
    budget, n = sources.agg(F.sum("target"), F.count("*")).head()
    budget, queue = budget or 0.0, queued(rows, sources, n)
    at = F.struct(*[F.lit(x) for x in cut_point(queue, round(budget, 3), turns)])
    return queue, [F.coalesce(F.struct(finish(i), "_src", "hash") <= at, F.lit(False)) for i in range(turns)], n


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken.

    ``taken`` is the number of words that the mix takes from the row, counting each time it is sent.  Null texts and
    texts without words have size 0 and are taken with 0; null sources are one source; exact repeats of one row
    are sent together; an empty table gives an empty result.  Other columns of ``docs`` are not read.
    """
    queue, sent, _ = planned(cut(sized(docs)), weights, share, most)  # the text is read once; the rest works on a few bytes a row
    taken = sum((F.when(s, F.col("size")).otherwise(F.lit(0)) for s in sent), F.lit(0))
    return queue.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The rows of ``docs`` that the mix sends, each as often as it is sent, with the columns of ``docs``.

    In a source's shuffled order the rows sent in one turn are those up to some hash, so a row per source (and turn)
    decides about all rows of the source and the texts are not shuffled.  Same cases as ``mix``.
    """
    queue, sent, n = planned(cut(sized(docs)), weights, share, most)
    upto = queue.groupBy("source").agg(*[F.max(F.when(s, F.col("hash"))).alias(f"_upto{i}") for i, s in enumerate(sent)])
    upto = upto.withColumnRenamed("source", "_s")
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))
    keyed = docs.select(F.struct("*").alias("doc"), F.col("source").alias("_source"), key.alias("_hash"))  # whatever names docs has
    times = sum((F.when(F.col("_hash") <= F.col(f"_upto{i}"), 1).otherwise(0) for i in range(len(sent))), F.lit(0))
    picked = keyed.join(beside(upto, n), F.col("_source").eqNullSafe(F.col("_s")))
    return picked.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.when(times > 0, times)))).select("doc.*")
