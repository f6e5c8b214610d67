"""Searches of a query set against all rows, in blocks of rows.

Rows are dealt into blocks of bounded size by a hash of their content.  A task reads one block's rows, builds its index
once, and streams the queries past it, so that no side has to fit into one task or be broadcast, and what moves is the
table once and each query once a block.  (A table of few blocks is searched by several tasks a block, each with a share
of the queries, so that all cores work.)  A task returns at most k rows for each query; the best k of all blocks are
then picked by a window over these few rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Components (rows times their length) of a block, and least number of queries that makes a share of its own.
BLOCK_CELLS, SHARE_ROWS = 1 << 22, 64


def usable(vectors: DataFrame, nonzero: bool) -> DataFrame:
    """vec_id, v (array of doubles), dim: rows with an id and a vector of finite numbers (not all zero, if ``nonzero``)."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    v = v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    if nonzero:
        v = v.where(F.exists("v", lambda x: x != 0))
    return v.withColumn("dim", F.size("v"))


def matrix(lists: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def best(vectors: DataFrame, is_query: Column, k: int, block_rows: int, build: Callable, ask: Callable, score_type: str, cells: int = BLOCK_CELLS) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k best rows by score, ties to the smaller vec_id.

    ``vectors`` has vec_id, v and dim; vectors meet only those of their own length.  ``build(ids, rows)`` makes the index
    of a block, ids ascending; ``ask(index, query_id, query)`` gives places in the block and scores, at least those of the
    block's k best, rows with the query's own id left out.  Every row is a candidate, so of rows that repeat an id each
    counts, exact repeats too; rows that repeat an id with different vectors are queries of their own, of exact repeats
    one asks.
    """
    spark = vectors.sparkSession
    # exact repeats become one row with their number, so that no block is made larger by one row met very often
    distinct = cut(vectors.groupBy("dim", "vec_id", "v").agg(F.count("*").alias("copies")))
    n, n_queries, n_cells = distinct.agg(F.count("*"), F.count_if(is_query), F.sum("dim")).head()
    n_blocks = max(1, math.ceil(n / block_rows), math.ceil((n_cells or 0) / cells))
    shares = max(1, min(math.ceil(2 * spark.sparkContext.defaultParallelism / n_blocks), math.ceil(n_queries / SHARE_ROWS)))
    block, share = F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_blocks)).cast("int"), F.pmod(F.xxhash64("vec_id", "v", F.lit(1)), F.lit(shares)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    rows = distinct.withColumn("rb", block).withColumn("qs", every(shares)).withColumn("asks", F.lit(False))
    queries = distinct.where(is_query).withColumn("rb", every(n_blocks)).withColumn("qs", share).withColumn("asks", F.lit(True))
    group = ["dim", "rb", "qs"]
    both = rows.unionByName(queries).repartition(n_blocks * shares, *group).sortWithinPartitions(*group, "asks")
    dtype = pa.int64() if score_type == "long" else pa.float64()

    def pieces(batches: Iterator[pa.RecordBatch]):
        """The batches cut where the block, or its part of rows or queries, changes."""
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*group, "asks")])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    yield tuple(key[:3, a]), bool(key[3, a]), batch.slice(a, b - a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, index, copies = None, [], None, None
        for key, asks, part in pieces(batches):
            if key != at:
                at, held, index = key, [], None
            ids, m = part.column("vec_id").to_numpy(), matrix(part.column("v"))
            if not asks:
                held.append((ids, m, part.column("copies").to_numpy()))
                continue
            if not held and index is None:
                continue  # no row of this length in the block
            if index is None:
                all_ids, all_rows, copies = (np.concatenate(x) for x in zip(*held))
                order = np.lexsort((*all_rows.T[::-1], all_ids)) if len(np.unique(all_ids)) < len(all_ids) else np.argsort(all_ids)
                block_ids, copies, held = all_ids[order], copies[order], []
                index = build(block_ids, all_rows[order])
            out = []
            for i, (q, v) in enumerate(zip(ids.tolist(), m, strict=True)):
                places, scores = ask(index, q, v)
                top = np.lexsort((block_ids[places], -scores))[:k]
                out.append((np.full(len(top), i), block_ids[places[top]], copies[places[top]], scores[top]))
            if out:
                asked, found, times, scores = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(ids[asked]), part.column("qk").take(pa.array(asked)), pa.array(found), pa.array(times), pa.array(scores, type=dtype)], names=["query_id", "qk", "vec_id", "copies", "score"])

    found = both.withColumn("qk", F.xxhash64("vec_id", "v")).mapInArrow(run, f"query_id long, qk long, vec_id long, copies long, score {score_type}")
    found = found.withColumn("_one", F.explode(F.array_repeat(F.lit(0), F.least("copies", F.lit(k)).cast("int"))))
    w = Window.partitionBy("query_id", "qk").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
