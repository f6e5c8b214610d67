"""Audit of how the filters of a corpus interact: what each removes, in every order they could be applied.

A document's failures are a mask, one bit a filter.  Documents are counted by part and mask first, so that all that
follows works on a few cells, 2^filters a part at most, however large the part.  Each cell then folds over all orders at
once: ``transform`` walks the constant array of orders, ``aggregate`` the steps of one, and each step gives the cell's
weights where they count (kept, removed, redundant).  The arrays of a part's cells are added up element by element.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

LETTERS = "ABCDE"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ("kept", "removed", "redundant", "good_lost", "toxic_lost")


def failures(text: Column | str) -> list[Column]:
    """Failure conditions A to D of a text (null: empty), each true or false.

    A: under 200 words.  B: fewer than half of the words are distinct.  C: more than 2 % of the code points are A to Z.
    D: one of # $ % & * | is there.  Words are runs of anything but the six ASCII white-space characters.
    """
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    words = F.array_remove(F.split(F.translate(t, "\t\n\x0b\x0c\r", "     "), " "), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.char_length(t) - F.char_length(F.translate(t, UPPER, ""))
    return [n < 200, distinct * 100 < n * 50, capitals * 100 > F.char_length(t) * 2, t.rlike("[#$%&*|]")]


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bit i: filter i fails), good, toxic (1 or 0) of every row of ``docs``.

    Filter E fails where a smaller doc_id has the same text, anywhere in the table; rows of a null id neither fail it nor
    make others fail.  A document labelled twice counts with its larger labels; missing labels are 0.
    """
    conditions = failures("text")
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)), F.lit(0))
    rows = cut(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), mask.cast("int").alias("mask")))
    # the least id of each text passes E: joined by id and text, so that a text with many copies is no hot key
    first = rows.where(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    out = rows.join(first, ["doc_id", "digest"], "left").join(known, "doc_id", "left")
    repeated = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 1 << len(conditions)).otherwise(0)
    is_one = lambda c: F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))
    return out.select("part", F.col("mask").bitwiseOR(repeated).alias("mask"), is_one("quality").alias("good"), is_one("toxic").alias("toxic"))


def orders(letters: str = LETTERS) -> list[str]:
    return ["".join(p) for p in permutations(letters)]


def audit(rows: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part, filter_order, step and counts of ``rows`` (part, mask, good, toxic): one row per part, order and step, zeros included.

    kept: left after the step; removed: by the step; redundant: fail its filter but were removed before; unique_fails:
    fail its filter alone; good_lost, toxic_lost: removed here with that label; shapley: what its filter removes, summed
    over all orders.  An empty table has no part and gives no row.
    """
    cells = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic"))
    zero = F.lit(0).cast("long")

    def folded(order: Column) -> Column:
        """The steps of one order, as structs of the cell's weights."""

        def step(done: Column, letter: Column) -> Column:
            fails = F.col("mask").bitwiseAND(F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(letters) for x in (c, 1 << i)]), letter)) != 0
            here = done["alive"] & fails
            weights = (done["alive"] & ~fails, here, ~done["alive"] & fails)
            counted = [F.when(w, F.col("n")).otherwise(zero).alias(k) for w, k in zip(weights, COUNTS)]
            lost = [F.when(here, F.col(c)).otherwise(zero).alias(k) for c, k in zip(("good", "toxic"), COUNTS[3:])]
            one = F.struct(order.alias("filter_order"), letter.alias("letter"), *counted, *lost)
            return F.struct((done["alive"] & ~fails).alias("alive"), F.concat(done["steps"], F.array(one)).alias("steps"))

        none = F.expr(f"CAST(array() AS ARRAY<STRUCT<filter_order: STRING, letter: STRING, {', '.join(f'{c}: BIGINT' for c in COUNTS)}>>)")
        return F.aggregate(F.filter(F.split(order, ""), lambda c: c != ""), F.struct(F.lit(True).alias("alive"), none.alias("steps")), step, lambda done: done["steps"])

    all_orders = F.array(*[F.lit(o) for o in orders(letters)])
    arrays = cells.select("part", "mask", "n", F.flatten(F.transform(all_orders, folded)).alias("steps"))

    def added(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: F.struct(x["filter_order"].alias("filter_order"), x["letter"].alias("letter"), *[(x[c] + y[c]).alias(c) for c in COUNTS]))

    # a part has at most 2^filters cells, so what is gathered is bounded
    per = arrays.groupBy("part").agg(F.collect_list("steps").alias("all"), F.collect_list(F.struct("mask", "n")).alias("cells"))
    per = per.select("part", "cells", F.aggregate(F.slice("all", 2, 1 << len(letters)), F.col("all")[0], added).alias("steps"))
    rows_ = per.select("part", "cells", F.posexplode("steps").alias("at", "s"))
    alone = F.aggregate(F.filter("cells", lambda c: c["mask"] == F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(letters) for x in (c, 1 << i)]), F.col("s.letter"))), zero, lambda acc, c: acc + c["n"])
    over = F.sum("s.removed").over(Window.partitionBy("part", "s.letter"))  # 120 orders of a letter
    return rows_.select(
        "part", "s.filter_order", (F.col("at") % len(letters) + 1).cast("int").alias("step"),
        "s.kept", "s.removed", "s.redundant", alone.alias("unique_fails"), "s.good_lost", "s.toxic_lost", over.alias("shapley"),
    )
