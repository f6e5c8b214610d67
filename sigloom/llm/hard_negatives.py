"""Hard negatives of anchors in a table of labelled vectors, by coordinate pruning over length buckets.

An anchor's positives are the rows of its label with the largest inner product; its hard negatives for a positive are
the rows of other labels that score nearly as high as the positive, but not higher.  Both are searches for all rows above
a threshold, which rises as rows are found.  Rows are dealt into blocks of bounded size by a hash, and anchors into
shares, so that a task holds one block and one share (a cogroup) whatever the label counts; labels are no partition key.

In a block, rows are sorted by length and cut into buckets of similar length.  A bucket whose longest row can't reach
the threshold ends the search.  Else the threshold becomes an angle around the anchor, and the angle a feasible range
for each coordinate of the rows' directions: the anchor's focus coordinates (its largest) look their ranges up in the
bucket's sorted coordinate lists, and only rows that are in all of them are verified by their exact inner product.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import matrix
from .common import cut

#: Rows and anchors that a task holds at most (about: they are dealt by a hash); components of such a block of rows.
BLOCK_ROWS, SHARE_ROWS, BLOCK_CELLS = 1 << 15, 1 << 13, 1 << 22
#: Coordinates of an anchor that look up ranges; rows of a bucket; shortest row of a bucket against its longest.
FOCUS, BUCKET_ROWS, SHORTEST = 4, 1024, 0.9
#: Slack of angles, far above the error of their arithmetic.
SLACK = 1e-7
_EXACT = float(1 << 53)


def products(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of whole-numbered vectors, exact: in doubles where every sum fits, else in Python's integers."""
    if not len(rows):
        return np.zeros(0, np.int64)
    if float(np.abs(rows).max()) * float(np.abs(q).max()) * rows.shape[1] < _EXACT:
        return (rows @ q).astype(np.int64)
    whole = [int(x) for x in q]
    return np.array([sum(int(a) * b for a, b in zip(r, whole, strict=True)) for r in rows.tolist()], dtype=np.int64)  # OverflowError if one doesn't fit


class Buckets:
    """Rows of one block in buckets of similar length, longest first, each with its sorted coordinate lists."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, bucket_rows: int = BUCKET_ROWS):
        with np.errstate(over="ignore"):
            norms = np.sqrt((rows * rows).sum(axis=1))
        order = np.argsort(-norms, kind="stable")
        self.ids, self.labels, self.rows, self.norms = ids[order], labels[order], rows[order], norms[order]
        self.starts = []
        for at, norm in enumerate(self.norms.tolist()):
            if not self.starts or at - self.starts[-1] >= bucket_rows or (norm < SHORTEST * self.norms[self.starts[-1]] and at - self.starts[-1] >= 64):
                self.starts.append(at)
        self.starts.append(len(ids))
        self._lists: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def _list(self, bucket: int, f: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted values of coordinate ``f`` of the bucket's directions, and whose they are; made at their first use."""
        if (bucket, f) not in self._lists:
            a, b = self.starts[bucket], self.starts[bucket + 1]
            values = self.rows[a:b, f] / np.where(self.norms[a:b] > 0, self.norms[a:b], 1)
            order = np.argsort(values, kind="stable")
            self._lists[bucket, f] = values[order], order
        return self._lists[bucket, f]

    def feasible(self, bucket: int, q: np.ndarray, q_norm: float, focus: np.ndarray, least: float) -> np.ndarray | None:
        """Places of the bucket whose score may be ``least`` or more; None if neither here nor in later buckets any is."""
        a, b = self.starts[bucket], self.starts[bucket + 1]
        long, short = float(self.norms[a]), float(self.norms[b - 1])
        if not (math.isfinite(long) and math.isfinite(q_norm)) or least == -math.inf:
            return np.arange(a, b)
        if least > q_norm * long * (1 + SLACK):
            return None
        base = q_norm * (long if least > 0 else short)
        cosine = least / base if base > 0 else -1.0
        if cosine <= -1:
            return np.arange(a, b)
        angle = math.acos(min(1.0, cosine)) + SLACK + math.sqrt(SLACK) * (cosine > 1 - SLACK)
        slices = []
        for f in focus.tolist():
            own = math.acos(max(-1.0, min(1.0, q[f] / q_norm)))
            values, whose = self._list(bucket, f)
            low, high = math.cos(min(math.pi, own + angle)) - SLACK, math.cos(max(0.0, own - angle)) + SLACK
            slices.append(whose[np.searchsorted(values, low) : np.searchsorted(values, high, side="right")])
        if min(map(len, slices)) == b - a:
            return np.arange(a, b)
        met = np.bincount(np.concatenate(slices), minlength=b - a) == len(slices)
        return a + np.flatnonzero(met)

    def search(self, q: np.ndarray, wanted: Callable[[np.ndarray], np.ndarray], least: Callable[[np.ndarray], float]) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of wanted rows, among them all with a score of at least what ``least(scores so far)`` gives at the end.

        ``wanted`` says which places count; the threshold may only rise as scores are added.
        """
        with np.errstate(over="ignore"):
            q_norm = float(np.sqrt((q * q).sum()))
        focus = np.argsort(-np.abs(q), kind="stable")[:FOCUS]
        places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for bucket in range(len(self.starts) - 1):
            found = self.feasible(bucket, q, q_norm, focus, least(scores))
            if found is None:
                break
            found = found[wanted(found)]
            places, scores = np.concatenate([places, found]), np.concatenate([scores, products(self.rows[found], q)])
        return places, scores


def _top(index: Buckets, places: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Which of the places are first: highest score, then smaller id."""
    return np.lexsort((index.ids[places], -scores))[:k]


def kth(scores: np.ndarray, k: int) -> float:
    """The ``k``-th highest score so far, which a row must reach to be among the first ``k``."""
    return float(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else -math.inf


def positives_of(index: Buckets, own_id: int, label: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    places, scores = index.search(q, lambda p: (index.labels[p] == label) & (index.ids[p] != own_id), lambda s: kth(s, k))
    top = _top(index, places, scores, k)
    return places[top], scores[top]


def negatives_of(index: Buckets, own_id: int, label: int, q: np.ndarray, goals: list[int], k: int, low: int, high: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each positive score g of ``goals`` the first ``k`` (places, scores) with low * g <= high * score <= high * g."""
    asked = [g for g in goals if g >= 0]  # below zero the range is empty
    if not asked:
        return [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in goals]

    def fits(scores: np.ndarray, g: int) -> np.ndarray:
        return (scores >= -(-low * g // high)) & (scores <= g)

    def least(scores: np.ndarray) -> float:
        return min(max(float(-(-low * g // high)), kth(scores[fits(scores, g)], k)) for g in asked)

    places, scores = index.search(q, lambda p: (index.labels[p] != label) & (index.ids[p] != own_id), least)
    out = []
    for g in goals:
        inside = np.flatnonzero(fits(scores, g)) if g >= 0 else np.zeros(0, np.int64)
        top = inside[_top(index, places[inside], scores[inside], k)]
        out.append((places[top], scores[top]))
    return out


def _dealt(rows: DataFrame, anchors: DataFrame, kernel: Callable, schema: str, n: int, n_anchors: int, cells: int, block_rows: int, share_rows: int):
    """``kernel(rows, anchors)`` of every block of rows with every share of anchors, both as Arrow tables."""
    par = rows.sparkSession.sparkContext.defaultParallelism
    n_blocks = max(1, math.ceil(n / block_rows), math.ceil(cells / BLOCK_CELLS))
    shares = max(1, math.ceil(n_anchors / share_rows), min(math.ceil(2 * par / n_blocks), math.ceil(n_anchors / 64)))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    block, share = F.pmod("key", F.lit(n_blocks)).cast("int"), F.pmod(F.xxhash64("key"), F.lit(shares)).cast("int")
    left = rows.withColumn("rb", block).withColumn("qs", every(shares))
    right = anchors.withColumn("rb", every(n_blocks)).withColumn("qs", share)
    keys = ["dim", "rb", "qs"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(kernel, schema)


def _index(rows: pa.Table) -> Buckets:
    return Buckets(rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), matrix(rows.column("v").combine_chunks()))


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, block_rows: int = BLOCK_ROWS, share_rows: int = SHARE_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for vectors of whole numbers.

    ``vectors`` has vec_id, label and embedding.  Positives of an anchor are its first rows of the same label, negatives of
    a positive its first rows of other labels with low * positive_score <= high * negative_score <= high * positive_score,
    by inner product with the anchor, ties by smaller vec_id.  Rows with a null id, label, vector or component or a
    non-finite component, and vectors of no components, take no part; vectors meet those of their own length; rows with the
    anchor's id are not its partners; exact repeats count once, while rows that repeat an id with another vector or label
    are rows (and anchors) of their own; a score that doesn't fit a long ends the query with an error.  An empty table, an
    anchor without positives and a positive without negatives in its range give no row.
    """
    v = vectors.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    v = v.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0))
    v = v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).distinct()
    rows = cut(v.withColumns({"dim": F.size("v"), "key": F.xxhash64("vec_id", "label", "v")}))
    anchors = rows.where(is_anchor)
    n, n_anchors, cells = rows.agg(F.count("*"), F.count_if(is_anchor), F.sum("dim")).head()
    size = dict(n=n, n_anchors=n_anchors, cells=cells or 0, block_rows=block_rows, share_rows=share_rows)

    def find_positives(own: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if own.num_rows and asked.num_rows:
            index = _index(own)
            for i, (a, lab, q) in enumerate(zip(asked.column("vec_id").to_pylist(), asked.column("label").to_pylist(), matrix(asked.column("v").combine_chunks()), strict=True)):
                places, scores = positives_of(index, a, lab, q, positives)
                out += [(asked.column("key")[i].as_py(), p, s) for p, s in zip(index.ids[places].tolist(), scores.tolist(), strict=True)]
        cols = list(zip(*out)) or [(), (), ()]
        return pa.table({"key": pa.array(cols[0], pa.int64()), "positive_id": pa.array(cols[1], pa.int64()), "positive_score": pa.array(cols[2], pa.int64())})

    near = _dealt(rows, anchors, find_positives, "key long, positive_id long, positive_score long", **size)
    first = Window.partitionBy("key").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("at", F.row_number().over(first)).where(F.col("at") <= positives)
    goals = near.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "positive_id", "positive_score"))).alias("goals"))
    asked = cut(anchors.join(goals, "key").select(*anchors.columns, F.col("goals.positive_score").alias("goal_scores"), F.col("goals.positive_id").alias("goal_ids")))

    def find_negatives(own: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if own.num_rows and asked.num_rows:
            index = _index(own)
            fields = zip(*[asked.column(c).to_pylist() for c in ("key", "vec_id", "label", "goal_ids", "goal_scores")], matrix(asked.column("v").combine_chunks()), strict=True)
            for key, a, lab, ids, scores, q in fields:
                found = negatives_of(index, a, lab, q, scores, negatives, low, high)
                for at, (pid, g, (places, s)) in enumerate(zip(ids, scores, found, strict=True)):
                    out += [(key, a, at, pid, g, x, y) for x, y in zip(index.ids[places].tolist(), s.tolist(), strict=True)]
        cols = list(zip(*out)) or [()] * 7
        names = ("key", "anchor_id", "at", "positive_id", "positive_score", "negative_id", "negative_score")
        return pa.table({k: pa.array(c, pa.int64()) for k, c in zip(names, cols, strict=True)})

    found = _dealt(rows, asked, find_negatives, "key long, anchor_id long, at long, positive_id long, positive_score long, negative_id long, negative_score long", **size)
    best = Window.partitionBy("key", "at").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mined(embeddings: DataFrame) -> DataFrame:
    """``hard_negatives`` of a table of embeddings: components become floor(256 * x), anchors are the ids divisible by 100, and
    labels of ids divisible by 7 move on by one (modulo 10) first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(_floor(x * 256.0)))
    return hard_negatives(embeddings.select("vec_id", label.alias("label"), whole.alias("embedding")), F.col("vec_id") % 100 == 0)


def _floor(x: Column) -> Column:
    """floor as a double: beyond 2^53 every double is whole, and floor() would give a long."""
    return F.when(F.abs(x) < _EXACT, F.floor(x).cast("double")).otherwise(x)
