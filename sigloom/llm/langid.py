"""Language identification by error-correcting output codes.

Every language gets a codeword of +1 and -1 bits; for each bit one binary classifier on hashed byte n-grams (one to
three bytes of the lower-cased text) says which side a text is on.  A text's language is the codeword with the least
loss, each bit's loss weighted by how well its classifier did on rows kept from its fit; a small lead over the
second-best codeword flags the answer as ambiguous.

The classifiers are fitted on the driver from the profiles of a bounded sample of rows with a language (``MOST_ROWS``, or
``LEAST_ROWS`` a language where that is more), and every language is learned;
every document is then decoded in its own task, from its whole text.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Rows that a fit uses, in expectation, dealt out in equal parts to the languages; rows that each language gets all the same
#: where there are more than MOST_ROWS / LEAST_ROWS of them; and width of the hashed feature space.
MOST_ROWS, LEAST_ROWS, WIDTH = 2400, 8, 4096
#: Up to so many languages the code has all splits of them; beyond, ``BITS`` random bits for each doubling of their number.
EXHAUSTIVE, BITS = 6, 10
UNKNOWN = "und"
PIECE = 1 << 20


def profile(text: str | None) -> np.ndarray:
    """Square roots of the shares of hashed n-grams in one whole text (zeros for none)."""
    raw = (text or "").lower().encode("utf-8", "surrogatepass")
    counts = np.zeros(WIDTH)
    for at in range(0, len(raw), PIECE):  # pieces overlap by two bytes, so that each n-gram counts once
        b = np.frombuffer(raw[at : at + PIECE + 2], dtype=np.uint8).astype(np.uint32)
        b = np.where((b >= 48) & (b <= 57), np.uint32(48), b)
        k = len(b)
        own = min(k, PIECE) if at + PIECE < len(raw) else k
        pair = b[:-1] * np.uint32(256) + b[1:] if k > 1 else b[:0]
        triple = pair[:-1] * np.uint32(256) + b[2:] if k > 2 else b[:0]
        for grams, salt in ((b, 0x9E3779B1), (pair, 0x85EBCA6B), (triple, 0xC2B2AE35)):
            mixed = (grams[:own] + np.uint32(1)) * np.uint32(salt)
            counts += np.bincount((mixed ^ (mixed >> np.uint32(15))) % np.uint32(WIDTH), minlength=WIDTH)
    return np.sqrt(counts / max(counts.sum(), 1.0))


def codewords(n: int) -> np.ndarray:
    """An n-row matrix of +1 and -1: every split of up to ``EXHAUSTIVE`` classes, else rows of a fixed random code, long
    enough that any two differ in a fifth of their bits."""
    if n < 2:
        return np.ones((n, 1))
    if n <= EXHAUSTIVE:
        return np.array([(1, *c) for c in itertools.product((1, -1), repeat=n - 1)][1:], dtype=float).T
    rng, bits = np.random.default_rng(7), BITS * math.ceil(math.log2(n))
    while True:
        for _ in range(20):
            code = rng.choice([-1.0, 1.0], size=(n, bits))
            apart = (bits - code @ code.T) / 2 + np.diag(np.full(n, np.inf))
            if (np.abs(code.sum(0)) < n).all() and apart.min() >= bits / 5:
                return code
        bits += BITS


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, its probability, and whether the runner-up is close."""
        f = x @ self.weights + self.bias
        loss = np.logaddexp(0, -f[:, None, :] * self.code[None, :, :]) @ self.trust
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        top = np.sort(p, axis=1)
        close = (top[:, -1] - top[:, -2] < 0.2) if p.shape[1] > 1 else np.zeros(len(x), bool)
        return loss.argmin(axis=1), p.max(axis=1), close

    def predict(self, texts) -> pd.DataFrame:
        lang, score, vague = [], [], []
        for t in texts:
            if not self.languages or t is None or not any(map(str.isalpha, t)):
                lang.append(UNKNOWN), score.append(0.0), vague.append(True)
                continue
            i, p, c = self.decode(profile(t)[None, :])
            lang.append(self.languages[i[0]]), score.append(float(p[0])), vague.append(bool(c[0]))
        return pd.DataFrame({"lang_pred": lang, "score": score, "ambiguous": vague})


def train(sample: list[tuple[str, str]], steps: int = 150, ridge: float = 1e-4) -> LanguageModel:
    """A model from (text, language) rows; rows without a letter take no part.  Of no rows, a model that answers ``und``."""
    sample = [(t, k) for t, k in sorted(sample, key=lambda r: (r[1], r[0])) if any(map(str.isalpha, t))]
    x = np.stack([profile(t) for t, _ in sample]) if sample else np.zeros((0, WIDTH))
    return learned(x.astype(np.float32), [k for _, k in sample], steps, ridge)


def learned(x: np.ndarray, of: list[str], steps: int = 150, ridge: float = 1e-4) -> LanguageModel:
    """A model from profiles and their languages."""
    langs = sorted(set(of))
    code = codewords(len(langs))
    if len(langs) < 2:
        return LanguageModel(langs, code, np.zeros((WIDTH, code.shape[1])), np.zeros(code.shape[1]), np.ones(code.shape[1]))
    at = np.searchsorted(np.array(langs, dtype=object), np.array(of, dtype=object))
    y = code[at].astype(np.float32)
    size = np.bincount(at, minlength=len(langs))
    w = (len(at) / len(langs) / size[at]).astype(np.float32)[:, None]  # each language weighs the same
    apart = np.arange(len(at)) % 5 == 4
    fit = ~apart if apart.any() and len(set(at[~apart])) == len(langs) else np.ones(len(at), bool)
    weights, bias = np.zeros((WIDTH, y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    last_w, last_b, xs, ys, ws = weights, bias, x[fit], y[fit], w[fit]
    for k in range(steps):  # accelerated gradient descent on the logistic loss of all bits at once
        m = k / (k + 3)
        vw, vb = weights + m * (weights - last_w), bias + m * (bias - last_b)
        slope = -ys * ws / (1 + np.exp(np.clip(ys * (xs @ vw + vb), -30, 30))) / len(xs)
        last_w, last_b = weights, bias
        weights, bias = vw - 6.0 * (xs.T @ slope + ridge * vw), vb - 1.0 * slope.sum(0)
    right = ((x[apart] @ weights + bias) * y[apart] > 0).mean(axis=0) if apart.any() else np.ones(y.shape[1])
    trust = np.clip(right - 0.5, 0.05, 0.5) * 2
    return LanguageModel(langs, code, weights.astype(float), bias.astype(float), trust)


def fit_rows(docs: DataFrame, keep: Column, most: int = MOST_ROWS, least: int = LEAST_ROWS) -> DataFrame:
    """text, lang: about ``most`` different rows that ``keep`` allows, in equal parts of the languages as far as they go, but
    ``least`` rows of each language, however many there are.

    Rows are chosen by a hash of id and text; the row of a language with the smallest hash is always among them, so that no
    language is missed by chance.
    """
    known = docs.select("doc_id", "text", "lang").where(keep & F.col("text").isNotNull() & F.col("lang").isNotNull())
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"), F.min(place).alias("first")).collect()  # a row a language
    part = max(most / max(1, len(sizes)), float(least))
    shares = [(r["lang"], max(int(min(1.0, part / r["n"]) * (1 << 20)), r["first"]) + 1) for r in sizes]
    share = F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, _share long"))
    picked = known.join(share, "lang").where(place < F.col("_share"))
    return picked.select("text", "lang").distinct()


def fitted(rows: DataFrame) -> LanguageModel:
    """A model from ``fit_rows``: profiles are made in tasks, so that no texts come to the driver."""

    @pandas_udf("at array<int>, share array<float>, letters boolean")
    def sparse(texts: pd.Series) -> pd.DataFrame:
        all_ = [profile(t) for t in texts]
        at = [np.flatnonzero(p) for p in all_]
        return pd.DataFrame({"at": [a.astype(np.int32) for a in at], "share": [p[a].astype(np.float32) for p, a in zip(all_, at)], "letters": [any(map(str.isalpha, t)) for t in texts]})

    found = rows.select("lang", F.sha2("text", 256).alias("name"), sparse("text").alias("p")).select("lang", "name", "p.at", "p.share", "p.letters").collect()
    got = sorted((r for r in found if r["letters"]), key=lambda r: (r["lang"], r["name"]))  # a filter in the plan would move before the choice of rows
    x = np.zeros((len(got), WIDTH), np.float32)
    for i, r in enumerate(got):
        x[i, r["at"]] = r["share"]
    return learned(x, [r["lang"] for r in got])


def language(model: LanguageModel, text: Column | str) -> Column:
    """struct(lang_pred, score, ambiguous) of each text; ``und`` with score 0 for a null text or one without a letter."""

    @pandas_udf("lang_pred string, score double, ambiguous boolean")
    def of(texts: pd.Series) -> pd.DataFrame:
        return model.predict(texts)

    return of(text)


def identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous for every row of ``docs``; only doc_id and text are read.

    A null text, and one without a letter, is ``und`` with score 0; texts of any length are read whole; of languages with
    equal loss the first by name is taken (and flagged as ambiguous); null ids and repeated rows come out like others; an
    empty table gives an empty result.
    """
    return docs.select("doc_id", language(model, "text").alias("l")).select("doc_id", "l.lang_pred", "l.score", "l.ambiguous")
