"""Exact top-k inner products over a bit-sliced index.

Components are quantised to integers and each block of rows is kept as bitmaps: for every component one bitmap a binary
digit (a slice), a row being one bit in each.  A query's score is a weighted sum of components, so the slices that its
weights call for are added up by bitmap arithmetic (full adders of and, or, xor over whole bitmaps) into the slices of
the score.  The best rows are picked from the most significant slice downward; rows that tie at the end are resolved
by their ids, which are in bit order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import best, usable

BLOCK_ROWS = 65536
#: Integers below this (in absolute value) are kept and added up as longs, larger ones as Python's integers.
WIDE = 1 << 62


def quantised(rows: np.ndarray, steps: int) -> np.ndarray:
    """floor(steps * x) of every component, as longs or, where one is too large for that, as Python's integers."""
    with np.errstate(over="ignore"):
        whole = np.floor(steps * rows)
    if (np.abs(whole) < WIDE / 2).all():
        return whole.astype(np.int64)
    exact = np.where(np.isfinite(whole), whole, 0.0).astype(object)
    out = np.vectorize(int, otypes=[object])(exact)
    for i, j in zip(*np.nonzero(~np.isfinite(whole)), strict=True):
        out[i, j] = steps * int(rows[i, j])  # doubles that large are whole numbers
    return out


class SlicedIndex:
    """Bitmaps of one block: ``ids`` ascending, ``rows`` their integer components (as many slices as they are wide)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.words = -(-len(ids) // 64)
        self.low = rows.min(axis=0)
        above = rows - self.low
        self.slices: list[list[np.ndarray]] = []
        self.inverse: list[list[np.ndarray]] = []
        for j in range(rows.shape[1]):
            planes = [self._bitmap((above[:, j] >> b & 1).astype(bool)) for b in range(int(above[:, j].max()).bit_length())]
            self.slices.append(planes)
            self.inverse.append([~p for p in planes])
        self.all = self._bitmap(np.ones(len(ids), bool))

    def _bitmap(self, bits: np.ndarray) -> np.ndarray:
        raw = np.packbits(bits, bitorder="little")
        return np.pad(raw, (0, 8 * self.words - len(raw))).view(np.uint64)

    def score_slices(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of each row's score less a constant.

        A negative weight takes the complement of its component's slices, which again differs by a constant only.
        """
        due: list[list[np.ndarray]] = []
        for j, w in enumerate(query.tolist()):
            planes = self.slices[j] if w > 0 else self.inverse[j]
            for i in range(abs(w).bit_length()):
                if abs(w) >> i & 1:
                    due.extend([] for _ in range(i + len(planes) - len(due)))
                    for b, p in enumerate(planes):
                        due[i + b].append(p)
        out, at = [], 0
        while at < len(due):
            column = due[at]
            carry: list[np.ndarray] = []
            while len(column) > 2:  # full adder: three bits of one weight become one of it and one of the next
                a, b, c = column.pop(), column.pop(), column.pop()
                half = a ^ b
                column.insert(0, half ^ c)
                carry.append((a & b) | (half & c))
            if len(column) == 2:
                a, b = column
                column = [a ^ b]
                carry.append(a & b)
            if carry:
                if at + 1 == len(due):
                    due.append([])
                due[at + 1].extend(carry)
            out.append(column[0] if column else np.zeros(self.words, np.uint64))
            at += 1
        return out

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``find``, with ids in place of places."""
        places, scores = self.find(query_id, query, k)
        return self.ids[places], scores

    def find(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places in the block, scores) of the k rows with the highest scores (all, if fewer), the query's own id left out."""
        open_ = self.all.copy()
        for own in range(*np.searchsorted(self.ids, [query_id, query_id + 1]).tolist()):
            open_[own // 64] &= ~(np.uint64(1) << np.uint64(own % 64))
        sure, need = np.zeros(self.words, np.uint64), k
        for s in reversed(self.score_slices(query)):
            high = open_ & s
            n = int(np.bitwise_count(high).sum())
            if n >= need:
                open_ = high
            else:
                sure |= high
                need -= n
                open_ = open_ & ~s
        where = lambda bits: np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little")[: len(self.ids)])
        places = np.concatenate([where(sure), where(open_)[:need]])
        return places, self._scores(places, query)

    def _scores(self, places: np.ndarray, query: np.ndarray) -> np.ndarray:
        rows = self.rows[places]
        bound = sum(int(w) * int(m) for w, m in zip(np.abs(query).tolist(), np.abs(rows).max(axis=0).tolist(), strict=True)) if len(places) else 0
        if bound < WIDE:
            return (rows @ query).astype(np.int64)
        scores = [sum(int(a) * int(b) for a, b in zip(r, query.tolist(), strict=True)) for r in rows.tolist()]
        if any(abs(s) >= 1 << 63 for s in scores):
            raise OverflowError("the score of a row among the best does not fit a long")
        return np.array(scores, dtype=np.int64)


def top_k(vectors: DataFrame, is_query: Column | None = None, k: int = 20, steps: int = 64, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row the k rows with the highest integer inner product.

    A component x counts as floor(``steps`` * x).  Queries are the rows with a vec_id divisible by 20 unless
    ``is_query`` says otherwise; candidates all rows with another id.  Rows with a null id or a vector that is null, empty
    or not finite take no part; vectors of different lengths don't meet.  Of rows that repeat an id each is a candidate
    (exact repeats too), each different vector a query of its own.  Components may be of any size; only a score among the
    best that doesn't fit a long ends the query with an error.  Ties go to the smaller vec_id; an empty table gives an
    empty result.
    """

    def ask(index: SlicedIndex, query_id: int, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return index.find(query_id, quantised(query[None, :], steps)[0], k)

    return best(
        usable(vectors, False), F.col("vec_id") % 20 == 0 if is_query is None else is_query, k, block_rows,
        lambda ids, rows: SlicedIndex(ids, quantised(rows, steps)), ask, "long",
    )
