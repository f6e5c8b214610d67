"""Toxicity by a weighted lexicon.

Texts are folded (letters without accents, lower case, look-alike letters of other scripts, digits and signs that stand
for letters, marks without width; i, l, 1 are one letter), and one pass of an Aho-Corasick automaton finds every stem of
the lexicon that starts a word (one of three letters: that is a word), and every exception phrase.  A hit inside an
exception phrase doesn't count.  What is left, weighted and normalised by length, gives the score through a calibrated
logistic curve.

Stems and weights are learned from a bounded sample of labelled rows, counted in tasks; a few plain insults are known
from the start.  Copies of a text count once in the learning.  A stem enters when its likelihood-ratio statistic is beyond what the
best of all candidates would reach by chance and nearly all documents that hold it are toxic.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import cut

#: Rows of each label that a fit uses at most, in expectation.
PER_CLASS = {0: 4000, 1: 2000}
STEM_LENGTHS = range(4, 13)
#: Texts of the sample that a task counts at a time.
COUNTED_TEXTS = 100
KNOWN = ("idiot", "moron", "stupid", "worthless", "scum", "loser", "pathetic", "disgusting", "imbecile", "dumbass")
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "class clown", "sore loser")
#: Letters of other scripts that look like Latin ones, and what stands for letters in disguised words.
LOOKALIKES = dict(zip("аеорсухіјѕкмтнвԁɡοαειικνρτυχѵⅼıłø", "aeopcyxijskmthbdgoaeiiknptuxviiio", strict=True))
DISGUISES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
#: Marks without width, and marks that combine with the letter before them.
_NO_WIDTH = {c: "" for c in "​‌‍⁠﻿­"}
_MARKS = {chr(c): "" for c in range(0x300, 0x370)}
_FOLD = str.maketrans(LOOKALIKES | DISGUISES | _NO_WIDTH | {"l": "i"})
_FOLD_PLAIN = str.maketrans(LOOKALIKES | DISGUISES | _NO_WIDTH | _MARKS | {"l": "i"})
_STROKE = re.compile(r"(?<=\w)[!|](?=\w)")
_TOKEN = re.compile(r"[^\W\d_]+")


def fold(text: str | None, plain: bool = False) -> str:
    """The folded text; ``plain`` takes off accents and other marks too."""
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKD" if plain else "NFKC", text)
    if "!" in text or "|" in text:
        text = _STROKE.sub("i", text)
    return text.lower().translate(_FOLD_PLAIN if plain else _FOLD)


@dataclass
class Lexicon:
    """Stem weights, exception phrases, and the curve: logistic of (1, weight of all hits, the same by length) times it."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-4.0, 1.0, 2.0)
    _automata: tuple = field(default=(), repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automata": ()}

    def automata(self) -> tuple:
        """For folded texts the whole lexicon; for those without their marks, the stems that have none themselves."""
        if not self._automata:
            made = []
            for ascii_only in (False, True):
                a = ahocorasick.Automaton()
                for phrase in self.exceptions:
                    a.add_word(fold(phrase), (len(fold(phrase)), None))
                for stem, w in self.weights.items():
                    if (folded := fold(stem)) not in a and (folded.isascii() or not ascii_only):
                        a.add_word(folded, (len(folded), w))
                a.make_automaton()
                made.append(a)
            self._automata = tuple(made)
        return self._automata

    def strength(self, text: str | None) -> tuple[float, float, int]:
        """(weight of all hits, the same by length, number of hits) of one whole text, the first two on a logarithmic
        scale; zeros for a null or empty one.  Of the readings with accents and without them the heavier counts."""
        whole, plain = self.automata()
        found = self._hits(fold(text), whole)
        return found if text is None or text.isascii() else max(found, self._hits(fold(text, plain=True), plain))

    def _hits(self, folded: str, automaton) -> tuple[float, float, int]:
        if not folded or not len(automaton):
            return 0.0, 0.0, 0
        hits, spared = [], []
        for end, (size, w) in automaton.iter(folded):
            start = end - size + 1
            if start and folded[start - 1].isalnum():
                continue  # within a word
            if size < STEM_LENGTHS[0] and end + 1 < len(folded) and folded[end + 1].isalnum():
                continue  # a short one must be the whole word
            if w is None:
                spared.append((start, end))
            else:
                hits.append((start, end, w))
        if spared:
            reach = max(b - a for a, b in spared) + 1
            hits = [h for h in hits if not _inside(h, spared, reach)]
        if not hits:
            return 0.0, 0.0, 0
        starts = {}
        for start, _, w in hits:  # of several stems that start one word the strongest counts
            starts[start] = max(w, starts.get(start, w))
        words = folded.count(" ") + folded.count("\n") + 1
        total = sum(starts.values())
        return math.log1p(total), math.log1p(100 * total / (words + 100)), len(starts)

    def scores(self, texts) -> tuple[np.ndarray, np.ndarray]:
        found = [self.strength(t) for t in texts]
        x = np.array([(1.0, *f[:2]) for f in found], dtype=float).reshape(-1, 3)
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.curve), -30, 30))), np.array([f[2] for f in found], dtype=np.int32)


def _inside(hit: tuple[int, int, float], spared: list[tuple[int, int]], reach: int) -> bool:
    """Whether a hit lies in one of the phrases, which are in order of their ends and ``reach`` characters long at most."""
    for i in range(bisect.bisect_left(spared, hit[1], key=lambda s: s[1]), len(spared)):
        if spared[i][0] <= hit[0]:
            return True
        if spared[i][1] > hit[1] + reach:  # from here on phrases begin after the hit
            return False
    return False


def stems_of(word: str) -> list[str]:
    """The stems that a folded word starts with; a word of three letters is one itself."""
    return [word] if len(word) == STEM_LENGTHS[0] - 1 else [word[:k] for k in STEM_LENGTHS if k <= len(word)]


def document_counts(rows: Iterable[tuple[str, int]]) -> dict[str, tuple[int, ...]]:
    """For each stem, how many toxic texts use it, how many more than once, and the same of clean ones."""
    held = [Counter() for _ in range(4)]
    for text, toxic in rows:
        times = Counter(s for w in _TOKEN.findall(fold(text)) for s in stems_of(w))
        at = 0 if toxic else 2
        held[at].update(times.keys())
        held[at + 1].update(s for s, n in times.items() if n > 1)
    return {s: tuple(h[s] for h in held) for s in held[0].keys() | held[2].keys()}


def use_counts(rows: Iterable[tuple[str, int]], stems: set[str]) -> tuple[Counter, Counter, set[tuple[str, str]]]:
    """How often each of ``stems`` starts a word in toxic texts, in clean ones, and the contexts of it in toxic ones: of each
    text the least (word before, word, word after), so that near copies of a text, which share it, count as one."""
    uses, other, around = Counter(), Counter(), set()
    for text, toxic in rows:
        words, least = ["", *_TOKEN.findall(fold(text)), ""], {}
        for i in range(1, len(words) - 1):
            for s in stems_of(words[i]):
                if s in stems:
                    (uses if toxic else other)[s] += 1
                    if toxic:
                        context = " ".join(words[i - 1 : i + 2])
                        least[s] = min(context, least.get(s, context))
        around.update(least.items())
    return uses, other, around


def known_counts(rows: Iterable[tuple[str, int]]) -> Counter:
    """How many clean texts hold each of ``KNOWN``."""
    out = Counter()
    for text, toxic in rows:
        if not toxic:
            folded = fold(text)
            out.update(s for s in KNOWN if fold(s) in folded)
    return out


def _g2(p: float, n: float, pos: int, neg: int) -> float:
    """Likelihood-ratio statistic of a term held by p of pos and n of neg documents."""
    out, total = 0.0, pos + neg
    for k, rows, held in ((p, pos, p + n), (n, neg, p + n), (pos - p, pos, total - p - n), (neg - n, neg, total - p - n)):
        if k > 0:
            out += 2 * k * math.log(k * total / (rows * held))
    return out


def candidates(held: dict[str, tuple[int, ...]], n_toxic: int, n_clean: int) -> dict[str, tuple[int, ...]]:
    """Stems of ``document_counts`` that at least three toxic texts use and that tell toxic texts from clean ones beyond chance."""
    frequent = {s: c for s, c in held.items() if c[0] >= 3}
    least = chance(len(frequent))
    return {s: c for s, c in frequent.items() if apart(c, math.inf, n_toxic, n_clean, least)}


def chance(n: int) -> float:
    """The likelihood-ratio statistic that the best of ``n`` stems rarely reaches by chance."""
    return 2 * math.log(max(n, 1) / 0.01)


def apart(c: tuple[int, ...], most: float, n_toxic: int, n_clean: int, least: float) -> bool:
    """Whether a stem tells the labels apart by the texts that use it, or by those that use it more than once."""
    pairs = ((min(c[0], most), c[2]), (min(c[1], most / 2), c[3]))
    return any(k * n_clean > m * n_toxic and _g2(float(k), float(m), n_toxic, n_clean) > least for k, m in pairs)


def weighed(held: dict[str, tuple[int, ...]], n_frequent: int, uses, other, around, known, sizes: list[tuple[int, float, int]], precision: float) -> Lexicon:
    """The lexicon of what was counted.  ``held`` has the candidates, ``around`` the number of contexts by stem, ``sizes`` for
    clean and toxic texts their number, their weight and their length."""
    weights: dict[str, float] = {}
    (n_clean, w_clean, l_clean), (n_toxic, w_toxic, l_toxic) = sizes
    if n_toxic and n_clean:
        least = chance(n_frequent)
        up = w_clean / n_clean / (w_toxic / n_toxic)
        stems = {s for s, c in held.items() if apart(c, around[s], n_toxic, n_clean, least) and uses[s] >= precision * (uses[s] + up * other[s])}
        w = {s: math.log((uses[s] + 0.5) / l_toxic) - math.log((other[s] + 0.5) / l_clean) for s in stems}
        longer = Counter()
        for s in stems:
            longer[s[:-1]] = max(longer[s[:-1]], held[s][0])
        stems = {s for s in stems if len(s) < STEM_LENGTHS[0] or longer[s] < 0.95 * held[s][0]}  # as long as it goes without losing documents
        for s in sorted(stems, key=lambda s: (len(s), s)):  # a longer one beside a shorter one only where it says more
            if all(w[s] > weights[s[:k]] + 0.7 for k in STEM_LENGTHS if s[:k] in weights and k < len(s)):
                weights[s] = round(w[s], 4)
    for s in KNOWN:
        if not any(fold(s)[:k] in weights for k in range(4, len(s) + 1)) and known[s] * 50 <= n_clean:
            weights[s] = 3.0
    return Lexicon(dict(sorted(weights.items())))


def train(sample: list[tuple[str, int, float]], precision: float = 0.5) -> Lexicon:
    """A lexicon from (text, label, weight) rows; of no rows, the known stems alone.

    A stem needs a likelihood-ratio statistic above chance, counting documents but near copies once (see ``use_counts``), and at least ``precision`` of its
    uses in toxic documents.  Its weight is the logarithm of how much more often it is used in toxic ones.
    """
    once = {}
    for t, y, w in sample:
        k, old = once.get(t, (0, 0.0))
        once[t] = (max(k, y), old + w)
    rows = [(t, y) for t, (y, _) in once.items()]
    sizes = [(len(own), sum(w for _, w in own), sum(n for n, _ in own)) for label in (0, 1) for own in [[(len(t), w) for t, (y, w) in once.items() if y == label]]]
    counts = document_counts(rows)
    held = candidates(counts, sizes[1][0], sizes[0][0]) if sizes[0][0] and sizes[1][0] else {}
    uses, other, around = use_counts(rows, held.keys())
    lex = weighed(held, sum(c[0] >= 3 for c in counts.values()), uses, other, Counter(s for s, _ in around), known_counts(rows), sizes, precision)
    return calibrated(lex, [(*lex.strength(t)[:2], y, w) for t, (y, w) in once.items()])


def fitted(rows: DataFrame, precision: float = 0.5) -> Lexicon:
    """As ``train``, from ``common.labelled_rows``: texts are counted in tasks, and counts and strengths come to the driver."""
    once = cut(rows.groupBy("text").agg(F.max("label").alias("label"), F.sum("weight").alias("weight")).repartition(2 * rows.sparkSession.sparkContext.defaultParallelism))

    def counted(of: Callable[[list[tuple[str, int]]], Iterable[tuple]], schema: str) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = list(zip(b["text"], b["label"], strict=True))
                for i in range(0, len(rows), COUNTED_TEXTS):
                    yield pd.DataFrame(list(of(rows[i : i + COUNTED_TEXTS])), columns=[c.split()[0] for c in schema.split(", ")])

        return once.select("text", "label").mapInPandas(run, schema)

    size = {r["label"]: tuple(r)[1:] for r in once.groupBy("label").agg(F.count("*"), F.sum("weight"), F.sum(F.char_length("text"))).collect()}
    sizes = [size.get(k, (0, 0.0, 0)) for k in (0, 1)]
    (n_clean, *_), (n_toxic, *_) = sizes
    names = ["toxic", "toxic2", "clean", "clean2"]
    counts = counted(lambda r: ((s, *c) for s, c in document_counts(r).items()), "stem string, toxic long, toxic2 long, clean long, clean2 long")
    frequent = cut(counts.groupBy("stem").agg(*[F.sum(c).alias(c) for c in names]).where("toxic >= 3"))
    more = frequent.where((F.col("toxic") * n_clean > F.col("clean") * n_toxic) | (F.col("toxic2") * n_clean > F.col("clean2") * n_toxic))
    n_frequent, held = frequent.count(), {}
    if n_clean and n_toxic:
        held = {r["stem"]: tuple(r[c] for c in names) for r in more.collect()}  # no more than the words of the sample
        held = {s: c for s, c in held.items() if apart(c, math.inf, n_toxic, n_clean, chance(n_frequent))}
    stems = set(held)

    def used(r: list[tuple[str, int]]) -> Iterator[tuple]:
        uses, other, around = use_counts(r, stems)
        yield from ((s, None, uses[s], other[s]) for s in uses.keys() | other.keys())
        yield from ((s, a, 0, 0) for s, a in around)
        yield from ((s, None, -1, n) for s, n in known_counts(r).items())

    found = counted(used, "stem string, around string, uses long, other long")
    is_known = F.col("uses") < 0
    sums = found.groupBy("stem").agg(F.sum(F.when(~is_known, F.col("uses"))), F.sum(F.when(~is_known, F.col("other"))), F.countDistinct("around"), F.sum(F.when(is_known, F.col("other")))).collect()
    uses, other, around, known = (Counter({r[0]: r[i] or 0 for r in sums}) for i in range(1, 5))
    lex = weighed(held, n_frequent, uses, other, around, known, sizes, precision)

    @pandas_udf("a double, b double")
    def strengths(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([lex.strength(t)[:2] for t in texts], columns=["a", "b"], dtype=float)

    got = once.select(strengths("text").alias("s"), "label", "weight").select("s.a", "s.b", "label", "weight").collect()
    return calibrated(lex, sorted(map(tuple, got)))


def calibrated(lex: Lexicon, rows: list[tuple[float, float, int, float]]) -> Lexicon:
    """Logistic curve by Newton steps with a small ridge, from (strength, the same by length, label, weight) rows; the default
    curve without rows of both labels."""
    if len({y for _, _, y, _ in rows}) < 2:
        return lex
    x = np.array([(1.0, a, b) for a, b, _, _ in rows])
    y, w = np.array([y for _, _, y, _ in rows], dtype=float), np.array([w for *_, w in rows])
    w = w / w.sum() * len(y)
    b, ridge = np.zeros(3), np.diag([1e-3, 1e-2, 1e-2])
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (w * q * (1 - q))[:, None]).T @ x + ridge, x.T @ (w * (q - y)) + ridge @ b)
        b -= np.clip(step, -2, 2)
    if b[1] + b[2] > 0:
        lex.curve = tuple(float(v) for v in b)
    return lex


def toxicity(lex: Lexicon, text: Column | str) -> Column:
    """struct(score, hits) of each text; null and empty texts score as texts without a hit."""

    @pandas_udf("score double, hits int")
    def of(texts: pd.Series) -> pd.DataFrame:
        score, hits = lex.scores(texts)
        return pd.DataFrame({"score": score, "hits": hits})

    return of(text)


def scored(docs: DataFrame, lex: Lexicon, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted (1 from ``threshold`` on) and hits for every row of ``docs``; other columns are not read.

    Null and empty texts score as texts without a hit; texts of any length are scored whole; of stems that start one word
    the heaviest counts; null ids and repeated rows come out like others; an empty table gives an empty result.
    """
    out = docs.select("doc_id", toxicity(lex, "text").alias("t")).select("doc_id", F.col("t.score").alias("score"), F.col("t.hits").alias("hits"))
    return out.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "hits")
