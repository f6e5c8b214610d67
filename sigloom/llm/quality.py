"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins; shallow trees, boosted in turn over the features, add up to one lookup table
per feature; a second pass boosts over the pairs of features whose joint bins explain most of what is left.  A text's
score is the sum of its bins' entries through the logistic function: a few additions, vectorised over a batch.

The model is fitted on the driver from the features of a bounded sample of labelled rows (``PER_CLASS`` rows of each
label); every document is then scored in its own task, from its whole text.
"""

from __future__ import annotations

import itertools
import math
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Rows of each label that a fit uses at most, in expectation.
PER_CLASS = {0: 2500, 1: 2500}
FEATURES = ["log_words", "word_length", "distinct_share", "top_share", "upper_share", "digit_share", "mark_share", "marked_words", "line_words", "line_repeats", "short_share", "packed", "longest_word"]
_KIND = np.zeros(256, dtype=np.int64)  # of a byte: 0 other, 1 lower-case letter or part of one, 2 upper-case, 3 digit, 4 white space, 5 mark
_KIND[33:127] = 5
_KIND[97:123] = _KIND[128:] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[[9, 10, 11, 12, 13, 32]] = 4


def features(text: str | None) -> list[float]:
    """The features of one text, all of it; a null text counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    kind = np.bincount(_KIND[np.frombuffer(raw, dtype=np.uint8)], minlength=6)
    ink = len(raw) - kind[4]
    lines = [x for x in raw.split(b"\n") if x]
    size = [len(w) for w in seen]
    marked = sum(k for w, k in seen.items() if not (w[-1:].isalnum() or w[-1] > 127 or w[-1:] in b".,"))
    short = sum(k for w, k in seen.items() if len(w) <= 3)
    return [
        math.log1p(n), ink / n, len(seen) / n, max(seen.values()) / n, kind[2] / ink, kind[3] / ink, kind[5] / ink, marked / n,
        math.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), short / n, len(zlib.compress(raw, 1)) / len(raw), math.log1p(max(size)),
    ]


@dataclass
class AdditiveModel:
    """``tables[i]`` has an entry for each bin of feature i, ``pairs`` a table of joint (coarser) bins for two features."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for i, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += t[np.searchsorted(e, x[:, i], side="right")]
        if self.pairs:
            c = [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.coarse)]
            for i, j, t in self.pairs:
                out += t[c[i], c[j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _step(g: np.ndarray, h: np.ndarray, splits: int, ridge: float) -> np.ndarray:
    """Leaf values by bin of a tree with ``splits`` splits on one binned feature, grown best first."""
    value, parts = np.zeros(len(g)), [(0, len(g))]
    cg, ch = np.concatenate([[0], g.cumsum()]), np.concatenate([[0], h.cumsum()])

    def best(lo: int, hi: int) -> tuple[float, int]:
        if hi - lo < 2:
            return 0.0, lo
        k = np.arange(lo + 1, hi)
        gl, hl, gr, hr = cg[k] - cg[lo], ch[k] - ch[lo], cg[hi] - cg[k], ch[hi] - ch[k]
        gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (cg[hi] - cg[lo]) ** 2 / (ch[hi] - ch[lo] + ridge)
        at = int(np.argmax(gain))
        return float(gain[at]), int(k[at])

    for _ in range(splits):
        gain, at, part = max(((*best(*p), p) for p in parts), key=lambda t: t[0])
        if gain <= 1e-9:
            break
        parts.remove(part)
        parts += [(part[0], at), (at, part[1])]
    for lo, hi in parts:
        value[lo:hi] = -(cg[hi] - cg[lo]) / (ch[hi] - ch[lo] + ridge)
    return value


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 120, rate: float = 0.15, bins: int = 32, coarse_bins: int = 8, n_pairs: int = 6, ridge: float = 2.0) -> AdditiveModel:
    """Cyclic boosting: one tree on each feature in turn, ``rounds`` times; then the same over the best pairs.

    Without rows of both labels the model scores every text with the share of label 1 (0.5 without any rows).
    """
    n, d = len(y), x.shape[1]
    weight = weight / weight.mean() if n else weight
    share = float(np.clip((weight @ y) / weight.sum(), 1e-3, 1 - 1e-3)) if n else 0.5
    base = math.log(share / (1 - share))
    if len(set(y.tolist())) < 2:
        return AdditiveModel(base, [np.zeros(0)] * d, [np.zeros(1)] * d, [np.zeros(0)] * d, [])
    edges, coarse = [_edges(x[:, i], bins) for i in range(d)], [_edges(x[:, i], coarse_bins) for i in range(d)]
    at = [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(edges)]
    ct = [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(coarse)]
    tables, f = [np.zeros(len(e) + 1) for e in edges], np.full(n, base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return weight * (p - y), weight * p * (1 - p)

    for _ in range(rounds):
        for i in range(d):
            g, h = slopes()
            v = rate * _step(np.bincount(at[i], g, len(tables[i])), np.bincount(at[i], h, len(tables[i])), 3, ridge)
            tables[i] += v
            f += v[at[i]]
    g, h = slopes()
    gains = []
    for i, j in itertools.combinations(range(d), 2):
        k, size = ct[i] * (len(coarse[j]) + 1) + ct[j], (len(coarse[i]) + 1) * (len(coarse[j]) + 1)
        gs, hs = np.bincount(k, g, size), np.bincount(k, h, size)
        gains.append((float((gs**2 / (hs + ridge)).sum()), i, j, k, size))
    pairs = []
    for _, i, j, k, size in sorted(gains, key=lambda t: (-t[0], t[1], t[2]))[:n_pairs]:
        pairs.append((i, j, k, np.zeros(size)))
    for _ in range(rounds // 4):
        for i, j, k, t in pairs:
            g, h = slopes()
            v = rate * -np.bincount(k, g, len(t)) / (np.bincount(k, h, len(t)) + ridge)
            t += v
            f += v[k]
    return AdditiveModel(base, edges, tables, coarse, [(i, j, t.reshape(len(coarse[i]) + 1, -1)) for i, j, _, t in pairs])


def train(sample: list[tuple[str, int, float]]) -> AdditiveModel:
    """A model from (text, label, weight) rows, see ``common.labelled_sample``."""
    x = np.array([features(t) for t, _, _ in sample], dtype=float).reshape(-1, len(FEATURES))
    return fit(x, np.array([k for _, k, _ in sample], dtype=float), np.array([w for _, _, w in sample], dtype=float))


def fitted(rows: DataFrame) -> AdditiveModel:
    """A model from ``common.labelled_rows``: features are made in tasks, so that numbers and no texts come to the driver."""
    got = sorted(map(tuple, rows.select(feature_column("text"), "label", "weight").collect()))
    x = np.array([r[0] for r in got], dtype=float).reshape(-1, len(FEATURES))
    return fit(x, np.array([r[1] for r in got], dtype=float), np.array([r[2] for r in got], dtype=float))


def feature_column(text: Column | str) -> Column:
    """``features`` of each text, as an array."""

    @pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    return of(text)


def quality_score(model: AdditiveModel, text: Column | str) -> Column:
    """Score between 0 and 1 of each text; null and empty texts are scored as texts without words."""

    @pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([features(t) for t in texts], dtype=float).reshape(-1, len(FEATURES))))

    return of(text)


def scored(docs: DataFrame, model: AdditiveModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, score and predicted (1 from ``threshold`` on) for every row of ``docs``; other columns are not read.

    Null, empty and blank texts have all features 0 and the score that follows; texts of any length are scored whole; null
    ids and repeated rows come out like others; equal texts have equal scores; an empty table gives an empty result.
    """
    out = docs.select("doc_id", quality_score(model, "text").alias("score"))
    return out.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
