"""Exact duplicates by a tree-merge of sorted digest runs, with built-in functions alone.

Each input partition makes a run: one row per digest, with the best identifier met and how many rows it stands for.
Runs merge in rounds, ``fan_in`` neighbours at a time, until one is left; its rows lie spread over all tasks by their
digest.  (The best is a struct, which Spark aggregates by sorting: a task merges sorted runs and streams over them.)
What a group's rows need to know then goes the same way back, round by round, so that a text with any number of copies
never has more than ``fan_in`` partners in a join, or one partition's rows in the last: no key of any step is hot.

Scale: a round moves at most one row of about 70 bytes per digest and run, whatever the texts' length; texts are read
once.  Rounds grow with the logarithm of the partitions: two for 256, five for a million.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

FAN_IN = 16


def _merged(runs: DataFrame, node: Column) -> DataFrame:
    """Runs of one ``node`` as one: the best row of each digest, the number of rows, and proof that all are one text.

    Each run brings length and second hash of the texts it stands for; where they differ under one digest, the query ends
    with an error instead of dropping a text.
    """
    out = runs.groupBy(node.alias("node"), "digest").agg(F.max("best").alias("best"), F.sum("n").alias("n"), F.min("proof").alias("proof"), F.max("proof").alias("other"))
    sure = F.when(F.col("proof") == F.col("other"), F.col("proof")).otherwise(F.raise_error(F.lit("different texts share a digest")))
    return out.select("node", "digest", "best", "n", sure.alias("proof"))


def duplicates(docs: DataFrame, text: Column | str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Rows with equal ``text`` (a null counts as empty) are a group; the row with the largest doc_id stays, a null id is less
    than any.  Of rows that repeat that id too, one stays.  text_sha256 is the digest of the UTF-8 bytes, so empty and null
    texts have that of no bytes.  Texts of any length are read whole; an empty table gives an empty result.
    """
    whole = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    row = F.monotonically_increasing_id()  # partition in the upper bits, place in it below; kept by the cut
    rows = docs.select("doc_id", whole.alias("_t")).select("doc_id", row.alias("row"), F.unhex(F.sha2("_t", 256)).alias("digest"), F.struct(F.octet_length("_t").alias("bytes"), F.xxhash64("_t").alias("hash")).alias("proof"))
    rows = cut(rows.withColumn("node", F.shiftrightunsigned("row", 33)))
    last = rows.agg(F.max("node")).head()[0] or 0

    single = rows.select("node", "digest", F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "row").alias("best"), F.lit(1).cast("long").alias("n"), "proof")
    levels = [cut(_merged(single, F.col("node")))]
    while last > 0:
        last //= fan_in
        levels.append(cut(_merged(levels[-1], F.floor(F.col("node") / fan_in))))

    # only groups of several rows go back down: the others know all of themselves
    told = levels[-1].where("n > 1").select("node", "digest", "best", "n")
    for runs in reversed(levels[:-1]):
        below = runs.select(F.col("node").alias("own"), F.floor(F.col("node") / fan_in).alias("node"), "digest")
        told = below.join(told, ["node", "digest"]).select(F.col("own").alias("node"), "digest", "best", "n")
    out = rows.join(told, ["node", "digest"], "left")
    kept = F.col("n").isNull() | (F.col("best.row") == F.col("row"))
    keep_id = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id"))
    return out.select("doc_id", keep_id.alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
