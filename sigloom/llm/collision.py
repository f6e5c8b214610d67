"""Approximate nearest neighbours by collision-counting hashing.

Each block of vectors is projected onto ``PROJECTIONS`` random lines and kept as one sorted array a line.  Around a
query's own projections windows are widened (virtual rehashing: the arrays stay, only the window's half-width, the
radius, grows); a vector collides on a line where it lies in the window.  Vectors that collide on enough lines are
verified by their inner product.  A vector no farther than the radius misses the threshold with a chance of about
``MISS``, so once the k-th best verified vector is no farther than the radius, the search of the block ends; no cap
on candidates cuts it short.

Inner products are turned into distances within the block: rows get one more coordinate that brings them to one
length, queries are scaled to it; nearest then means largest inner product.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import best, usable

PROJECTIONS, MISS, SEED = 64, 0.1, 11
#: Rows of a block (larger ones, which a hash may deal, take ranks of 32 bits instead of 16), and how many of the most
#: colliding rows the first look verifies (at least ten times k).
BLOCK_ROWS, FIRST_LOOK = 1 << 16, 256


def _threshold(lines: int, miss: float) -> int:
    """Collisions that a vector at the radius reaches with a chance of 1 - ``miss``: windows hold it with chance P(|N(0,1)| < 1)."""
    p = math.erf(1 / math.sqrt(2))
    chance, k = 0.0, -1
    while chance <= miss:
        k += 1
        chance += math.comb(lines, k) * p**k * (1 - p) ** (lines - k)
    return k


class Index:
    """Sorted projections of one block."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, lines: int = PROJECTIONS, seed: int = SEED):
        self.ids, self.rows, self.lines = ids, rows, lines
        self.thresholds: dict[float, int] = {}
        self.scale = np.abs(rows).max() or 1.0  # so that squares neither overflow nor vanish
        unit = rows / self.scale
        norms = np.sqrt((unit * unit).sum(axis=1))
        self.length = norms.max() or 1.0
        self.unit = unit.astype(np.float32)  # for looking; scores come from ``rows``
        self.dirs = np.random.default_rng(seed).standard_normal((rows.shape[1] + 1, lines))
        spots = unit @ self.dirs[:-1] + np.sqrt(np.maximum(self.length**2 - norms**2, 0))[:, None] * self.dirs[-1]
        self.order = np.ascontiguousarray(np.argsort(spots, axis=0, kind="stable").T.astype(np.int32))
        self.sorted = np.ascontiguousarray(np.take_along_axis(spots.T, self.order.astype(np.int64), axis=1))

        self.ranks = np.empty(self.order.shape, np.uint16 if len(ids) <= 1 << 16 else np.uint32)
        np.put_along_axis(self.ranks, self.order.astype(np.int64), np.arange(len(ids), dtype=self.ranks.dtype)[None, :], axis=1)

    def _counts(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """On how many lines each row lies in the window [lo, hi) of the line's sorted array."""
        n = len(self.ids)
        if (hi - lo).sum() * 12 < n * self.lines:
            held = [self.order[j, a:b] for j, (a, b) in enumerate(zip(lo, hi, strict=True)) if b > a]
            return np.bincount(np.concatenate(held), minlength=n) if held else np.zeros(n, np.int64)
        full = int((hi - lo >= n).sum())  # wide windows: by the rows' places in the arrays, which costs no scattered reads
        some = hi - lo < n
        place = self.ranks[some] if full else self.ranks
        inside = place - lo[some].astype(place.dtype)[:, None] < (hi - lo)[some].astype(place.dtype)[:, None]
        return inside.view(np.uint8).sum(axis=0, dtype=np.uint8 if self.lines < 256 else np.int32) + np.int64(full)

    def least(self, miss: float) -> int:
        if miss not in self.thresholds:
            self.thresholds[miss] = _threshold(self.lines, miss)
        return self.thresholds[miss]

    def search(self, query_id: int, query: np.ndarray, k: int, miss: float = MISS) -> tuple[np.ndarray, np.ndarray, int]:
        """As ``find``, with ids in place of places."""
        places, scores, n_seen = self.find(query_id, query, k, miss)
        return self.ids[places], scores, n_seen

    def find(self, query_id: int, query: np.ndarray, k: int, miss: float = MISS) -> tuple[np.ndarray, np.ndarray, int]:
        """(places in the block, scores, number of rows verified): at least the k nearest, and with them the others that
        may tie; rows with the query's own id are left out."""
        n = len(self.ids)
        own = slice(*np.searchsorted(self.ids, [query_id, query_id + 1]))
        q = query / np.abs(query).max()
        q = q / math.sqrt(float(q @ q)) * self.length
        at, least = q @ self.dirs[:-1], self.least(miss)
        q32 = q.astype(np.float32)
        seen = np.zeros(n, bool)
        near = np.full(n, -np.inf, np.float32)  # inner product with the scaled query, of verified rows

        def verify(which: np.ndarray) -> None:
            near[which] = (self.unit[which] if len(which) < n else self.unit) @ q32
            seen[which] = True

        def kth() -> float:
            """Distance of the k-th nearest verified row."""
            ok = near[seen]
            if len(ok) < k:
                return math.inf
            return math.sqrt(max(0.0, 2 * self.length**2 - 2 * float(np.partition(ok, len(ok) - k)[len(ok) - k])))

        seen[own] = True  # never verified: their places stay at minus infinity
        mid = np.array([np.searchsorted(self.sorted[j], at[j]) for j in range(self.lines)])
        reach = max(n // 32, 1)
        counts = self._counts(np.maximum(mid - reach, 0), np.minimum(mid + reach, n))
        first = min(max(FIRST_LOOK, 10 * k), n)
        look = np.sort(np.argpartition(counts, n - first)[n - first :])
        verify(look[~seen[look]])
        radius = 0.92 * kth()
        while True:
            if math.isinf(radius):  # fewer than k rows verified: the window is the whole line
                verify(np.flatnonzero(~seen))
                break
            lo = np.array([np.searchsorted(s, x - radius) for s, x in zip(self.sorted, at, strict=True)])
            hi = np.array([np.searchsorted(s, x + radius, side="right") for s, x in zip(self.sorted, at, strict=True)])
            verify(np.flatnonzero((self._counts(lo, hi) >= least) & ~seen))
            far = kth()
            if far <= radius * (1 + 1e-6):
                break
            radius = far
        near[own] = -np.inf
        n_seen = int(seen.sum())
        good = np.flatnonzero(np.isfinite(near))
        if len(good) > k:
            edge = np.partition(near[good], len(good) - k)[len(good) - k]
            good = good[near[good] >= edge - 2e-6 * self.length**2]
        return good, (self.rows[good] * query).sum(axis=1), n_seen  # row by row alike, so that equal rows tie


def nearest(vectors: DataFrame, is_query: Column | None = None, k: int = 20, block_rows: int = BLOCK_ROWS, lines: int = PROJECTIONS, miss: float = MISS) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its k nearest found by inner product, in double precision.

    Queries are the rows with a vec_id divisible by 20 unless ``is_query`` says otherwise; candidates all rows with another
    id.  Rows with a null id or a vector that is null, empty, zero or not finite take no part; vectors of different
    lengths don't meet.  Of rows that repeat an id each is a candidate (exact repeats too), each different vector a query
    of its own.  Ties go to the smaller vec_id; an empty table gives an empty result.  Very long vectors make blocks of
    fewer rows.
    """
    mean = max(1, block_rows - 4 * math.isqrt(block_rows))  # blocks dealt by a hash scatter by the root of their size
    return best(
        usable(vectors, True), F.col("vec_id") % 20 == 0 if is_query is None else is_query, k, mean,
        lambda ids, rows: Index(ids, rows, lines), lambda index, q, v: index.find(q, v, k, miss)[:2], "double",
    )
