"""SentencePiece encoding and decoding by a streaming Viterbi pass.

Position by position, the pass keeps for every boundary one surviving backpointer: the last piece of the best reading
of the text up to there.  Only boundaries within the longest piece's length can still be continued, so once all their
paths lead back through one boundary, everything before it is certain; its ids are committed and the window moves on.

For a unigram model the survivor is the reading with the highest score.  For a BPE model it is the reading that the
merges make: the one whose last two pieces, merged from their characters, come out as just these two (a boundary has
exactly one such reading, and what holds for all neighbours holds for the whole), so ids equal the merge procedure's.

No piece spans the start of a word (checked for each model), so all paths meet there: the pass takes one word at a
time (of any length), and what was committed for a word is remembered for its next use, in a table of bounded size.
"""

from __future__ import annotations

import re
import struct
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Default model file; every function takes another.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Characters read between two looks for a common boundary; words (twice as many at most) and pairs of pieces that a worker
#: remembers.
LOOK_EVERY, REMEMBERED = 128, 100_000
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6


def _fields(data: bytes):
    """(number, value) of the fields of one protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            b = data[at]
            out, at, shift = out | (b & 127) << shift, at + 1, shift + 7
            if b < 128:
                return out, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else varint(at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class PieceModel:
    """A SentencePiece model file: pieces by id, and encoding and decoding with them."""

    def __init__(self, data: bytes):
        self.text: list[str] = []
        self.score: list[float] = []
        self.kind: list[int] = []
        kind_of_model, self.prefix, squeeze, charsmap = 1, True, True, b""
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                self.text.append(f[1].decode())
                self.score.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                self.kind.append(f.get(3, NORMAL))
            elif number == 2:
                kind_of_model = dict(_fields(value)).get(3, 1)
            elif number == 3:
                f = dict(_fields(value))
                self.prefix, squeeze, charsmap = bool(f.get(3, 1)), bool(f.get(4, 1)), f.get(2, b"")
        if kind_of_model not in (1, 2) or USER_DEFINED in self.kind:
            raise ValueError("only unigram and BPE models without user-defined pieces are read")
        self.merging = kind_of_model == 2
        self.ids = {t: i for i, t in enumerate(self.text) if self.kind[i] == NORMAL}
        self.longest = max(map(len, self.ids), default=1)
        self.matcher = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.matcher.add_word(t, (len(t), i))
        self.matcher.make_automaton()
        self.unknown = self.kind.index(UNKNOWN) if UNKNOWN in self.kind else 0
        self.bytes = {int(t[1:-1], 16): i for i, t in enumerate(self.text) if self.kind[i] == BYTE}
        self.raw = [bytes([int(t[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else t.replace(SPACE, " ").encode() for t, k in zip(self.text, self.kind, strict=True)]
        if UNKNOWN in self.kind:
            self.raw[self.unknown] = " ⁇ ".encode()
        self.normalizer = None
        if charsmap or squeeze:
            import sentencepiece

            self.normalizer = sentencepiece.SentencePieceProcessor(model_proto=data).normalize
        several = {c for t in self.ids if len(t) > 1 for c in t}
        if self.merging and not several <= self.ids.keys():
            raise ValueError("a BPE model must hold every character of its pieces as a piece")
        if not any(re.search(f"[^{SPACE}]{SPACE}", t) for t in self.ids):
            line = "\n|" if "\n" not in several else ""
            apart = f"\n{SPACE}" if line else SPACE
            self.cutter = re.compile(f"{line}{SPACE}*[^{apart}]+|{SPACE}+")
        else:
            self.cutter = re.compile("(?s).+")
        self.worst = min((self.score[i] for i in self.ids.values()), default=0.0) - 10.0
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.fits: list[dict[int, bool]] = [{} for _ in self.text]  # by the first piece, then the second
        self.n_fits = 0
        self.stories: dict[int, tuple[list[float], list[str], list[str]]] = {}

    def _single(self, c: str) -> tuple[int, ...]:
        """Ids of one character that is no piece: its bytes, or the unknown id."""
        raw = c.encode("utf-8", "surrogatepass")
        return tuple(self.bytes[b] for b in raw) if all(b in self.bytes for b in raw) else (self.unknown,)

    def _story(self, piece: int) -> tuple[list[float], list[str], list[str]]:
        """How a piece is merged from its characters, step by step (the best-scored neighbours first, the leftmost of
        equals): the score of each merge, and the first and the last part before each merge and at the end."""
        known = self.stories.get(piece)
        if known is None:
            parts, scores = list(self.text[piece]), []
            first, final = [parts[0]], [parts[-1]]
            while True:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    k = self.ids.get(parts[i] + parts[i + 1])
                    if k is not None and (best is None or self.score[k] > best):
                        best, at = self.score[k], i
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                scores.append(best)
                first.append(parts[0]), final.append(parts[-1])
            known = self.stories[piece] = (scores, first, final) if len(parts) == 1 else ([], [], [])
        return known

    def _fit(self, a: int, b: int) -> bool:
        """Whether merging the characters of two pieces gives these two again.

        Both pieces' merges go on side by side, the better one first; they fit if a merge across the border is never
        the best of the three.
        """
        (sa, _, la), (sb, fb, _) = self._story(a), self._story(b)
        i = j = 0
        fit = bool(la and fb)  # a piece that merges never make fits nowhere
        while fit:
            k = self.ids.get(la[i] + fb[j])
            cross = None if k is None else self.score[k]
            left, right = sa[i] if i < len(sa) else None, sb[j] if j < len(sb) else None
            if cross is not None and (left is None or cross > left) and (right is None or cross >= right):
                fit = False
            elif left is not None and (right is None or left >= right):
                i += 1
            elif right is not None:
                j += 1
            else:
                break
        self.n_fits += 1
        if self.n_fits >= REMEMBERED:
            for row in self.fits:
                row.clear()
            self.n_fits = 0
        self.fits[a][b] = fit
        return fit

    def viterbi(self, s: str) -> list[int]:
        """Ids of a normalised stretch of text, committed as soon as all surviving paths agree.

        An Aho-Corasick automaton over the pieces tells, position by position, which pieces end there, the longest first.
        """
        out: list[int] = []
        (self._by_merges if self.merging else self._by_scores)(s, out)
        return out

    # ``back`` and ``last`` hold for each boundary of the window, which starts at the committed place ``base``, where its last
    # piece starts (counted from there) and which it is: -1 for a character that is no piece.

    def _commit(self, s: str, base: int, upto: int, back: list[int], last: list[int], out: list[int]) -> None:
        """Write the ids of the path to the ``upto``-th boundary of the window."""
        steps, at = [], upto
        while at > 0:
            steps.append((at, last[at]))
            at = back[at]
        for at, piece in reversed(steps):
            if piece >= 0:
                out.append(piece)
            else:
                out.extend(self._single(s[base + at - 1]))

    def _advance(self, s: str, base: int, back: list[int], last: list[int], out: list[int]) -> int:
        """Commit a full window up to the last boundary on all paths to its end, and move it on; how far it moved.

        Every later piece starts at one of the last boundaries: their paths are followed back until they meet.
        """
        full = len(last) - 1
        alive = set(range(max(0, full + 1 - self.longest), full + 1))
        while len(alive) > 1:
            far = max(alive)
            alive.discard(far)
            alive.add(back[far])
        met = alive.pop()
        self._commit(s, base, met, back, last, out)
        last[:] = last[met:] + [-1] * LOOK_EVERY  # the piece before the cut still decides which pieces may follow it
        back[:] = [k - met for k in back[met:]] + list(range(full - met, full - met + LOOK_EVERY))
        return met

    def _by_merges(self, s: str, out: list[int]) -> None:
        """The pass for BPE models: of the pieces that end at a boundary one fits, and none after it is looked at."""
        n, base, settled = len(s), 0, 0
        width = min(n, LOOK_EVERY + self.longest)
        last, back, fits, limit = [-2] + [-1] * width, list(range(-1, width)), self.fits, width
        for at, (size, piece) in self.matcher.iter(s):
            at += 1
            if at == settled:
                continue
            while at > limit:
                base += self._advance(s, base, back, last, out)
                limit = base + len(last) - 1
            before = last[at - base - size]
            if before >= 0:
                fit = fits[before].get(piece)
                if fit is None:
                    fit = self._fit(before, piece)
                if not fit:
                    continue
            settled = at
            last[at - base], back[at - base] = piece, at - base - size
        while n > limit:
            base += self._advance(s, base, back, last, out)
            limit = base + len(last) - 1
        self._commit(s, base, n - base, back, last, out)

    def _by_scores(self, s: str, out: list[int]) -> None:
        """The pass for unigram models: the reading with the highest score survives; scores count from the cut."""
        n, base, end = len(s), 0, 0
        width = min(n, LOOK_EVERY + self.longest)
        last, back, best, limit = [-2] + [-1] * width, list(range(-1, width)), [0.0] * (width + 1), width

        def moved() -> None:
            nonlocal base, limit
            met = self._advance(s, base, back, last, out)
            base, limit = base + met, base + met + len(last) - 1
            best[:] = [v - best[met] for v in best[met:]] + [0.0] * LOOK_EVERY

        def reached(upto: int) -> None:
            nonlocal end
            while end < upto:
                end += 1
                if end > limit:
                    moved()
                best[end - base] = best[end - base - 1] + self.worst  # until a piece is found to end there

        for at, (size, piece) in self.matcher.iter(s):
            reached(at + 1)
            i = end - base
            if (value := best[i - size] + self.score[piece]) > best[i] or last[i] < 0:
                last[i], back[i], best[i] = piece, i - size, value
        reached(n)
        self._commit(s, base, n - base, back, last, out)

    def normalized(self, text: str) -> str:
        if self.normalizer is not None:
            return self.normalizer(text)
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)

    def encode_into(self, text: str, out: bytearray) -> None:
        """Append the ids of one whole text, as 32-bit integers.

        Every word goes through ``viterbi``; its ids are then remembered.  When the table of remembered words is full it becomes
        the old one, whose words move to the new one when they are met again, and the old one before it is dropped.
        """
        known, old = self.known, self.old
        for w in self.cutter.findall(self.normalized(text)):
            ids = known.get(w)
            if ids is None:
                ids = old.get(w)
                if ids is None:
                    ids = array("i", self.viterbi(w)).tobytes()
                if len(w) <= 48:
                    if len(known) >= REMEMBERED:
                        self.old = old = known
                        self.known = known = {}
                    known[w] = ids
            out += ids

    def encode(self, text: str) -> array:
        """Ids of one whole text."""
        raw = bytearray()
        self.encode_into(text, raw)
        return array("i", bytes(raw))

    def decode(self, ids) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return raw[1:] if self.prefix and raw.startswith(" ") else raw


@lru_cache(maxsize=2)
def load(data: bytes) -> PieceModel:
    return PieceModel(data)


def read_model(path: str = MODEL) -> bytes:
    """The model file, read once on the driver; tasks get its content (under 1 MB), not its path."""
    with open(path, "rb") as f:
        return f.read()


def encoded(model: bytes, text: Column | str) -> Column:
    """struct(ids, exact) of each text; ``exact`` tells whether decoding the ids gives the text again.  Both null for a null text."""

    @arrow_udf("ids array<int>, exact boolean")
    def of(texts: pa.Array) -> pa.Array:
        m, flat, ends, exact = load(model), bytearray(), [0], []  # ids of a batch in one buffer, which Arrow then takes as it is
        for t in texts:
            t = t.as_py()
            if t is None:
                exact.append(None)
            else:
                m.encode_into(t, flat)
                exact.append(m.decode(array("i", bytes(memoryview(flat)[4 * ends[-1] :]))) == t)
            ends.append(len(flat) // 4)
        values = pa.array(np.frombuffer(flat, dtype=np.int32))
        lists = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), values, mask=pa.array([e is None for e in exact], type=pa.bool_()))
        return pa.StructArray.from_arrays([lists, pa.array(exact, type=pa.bool_())], names=["ids", "exact"])

    return of(text)


def decoded(model: bytes, ids: Column | str) -> Column:
    """Text of each list of ids; null for a null list, empty for an empty one."""

    @arrow_udf("string")
    def of(lists: pa.Array) -> pa.Array:
        m = load(model)
        return pa.array([None if r is None else m.decode(r) for r in lists.to_pylist()], type=pa.string())

    return of(ids)


def tokenized(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, ids, n_ids and exact for every row of ``docs``; only doc_id and text are read.

    An empty text has no ids; a null one null ids, n_ids 0 and exact null.  Texts of any length are encoded whole; of two
    readings that merge alike the leftmost merge decides, as in the model's own procedure; null ids and repeated rows come
    out like others; an empty table gives an empty result.  ``exact`` is false only where a text holds the sign U+2581,
    which the model reads as a space.
    """
    out = docs.select("doc_id", encoded(read_model(path), "text").alias("e"))
    return out.select("doc_id", "e.ids", F.coalesce(F.size("e.ids"), F.lit(0)).alias("n_ids"), "e.exact")
