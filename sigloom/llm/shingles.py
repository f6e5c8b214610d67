"""Sets of word shingles, and wide fingerprints of them that find sets of true similarity ``SIMILAR`` or more.

The similarity of two texts is the Jaccard similarity of their sets of shingles.  A fingerprint holds ``BANDS`` bands of
``BITS`` bits, each bit a majority vote over the hashes of the shingles, as in op5 but wider.  At a similarity of 0.8 a bit
differs with a chance of 0.152, and what differs are the votes that were close: so the Hamming ball around a band, which
op5 looks up whole, is looked up where it is likely, at the band itself and with one of its ``CLOSE`` closest votes turned
(a few more where sets are so small that votes tie).  Two texts meet in a band that differs in at most two such votes (a
chance of 0.31 at 0.8) if the least shingles in the band's own ``LEAST`` orders are the same in both (0.64): these are in
the key, so that texts that share none don't meet by chance, and those that share a passage seldom, however many there
are.  All bands together miss about 1 pair in 30,000 at 0.8, and far fewer above.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

SIMILAR = 0.8
BANDS, BITS, LEAST = 48, 16, 2
#: Votes of a band that are turned, one at a time, to look around it, and how many more where a set is small (see ``turned``).
CLOSE, FEW = 2, 80
#: A shingle that one in so many sets of a group holds is frequent there: a group has at most so many times its mean set of them.
OFTEN = 16
#: Shingles hashed at a time, so that one very long text stays within a few MB.
HASH_BLOCK = 2048

_RANDOM = np.random.default_rng(23)
_ODD = _RANDOM.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _RANDOM.integers(0, 1 << 32, (BANDS * LEAST, 1), dtype=np.uint32)
_TIMES = _RANDOM.integers(0, 1 << 31, (BANDS * LEAST, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_WORDS = _RANDOM.integers(0, 1 << 63, -(-BANDS * BITS // 64), dtype=np.uint64)
_BIT = 1 << np.arange(BITS)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text; all of a shorter text is one, a wordless text has none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes both act on ASCII alone
    if not parts:
        return np.zeros(0, np.uint64)
    own = np.array([xxhash.xxh64_intdigest(p, 42) for p in parts], dtype=np.uint64)
    width = min(words, len(own))
    n = len(own) - width + 1
    total = np.full(n, width, np.uint64)
    for j in range(width):
        total += own[j : j + n] * _ODD[j]
    return np.unique(_mixed(total))


def votes(hashes: np.ndarray) -> np.ndarray:
    """Shingles for a bit minus shingles against it, for all bits of the fingerprint, as bands by bits."""
    total = np.zeros(BANDS * BITS, np.int64)
    for at in range(0, len(hashes), HASH_BLOCK):
        words = _mixed(hashes[at : at + HASH_BLOCK, None] ^ _WORDS).astype("<u8")
        bits = np.unpackbits(words.view(np.uint8), axis=1, count=BANDS * BITS, bitorder="little")
        total += bits.sum(axis=0, dtype=np.uint16)
    return (2 * total - len(hashes)).reshape(BANDS, BITS)


def turned(n: int) -> int:
    """Votes of a band that a set of n shingles turns: 12 for 4 shingles, 6 for 16, ``CLOSE`` from 77 on."""
    return CLOSE + FEW // (n + 4)


def sketch(hashes: np.ndarray) -> tuple[int, np.ndarray]:
    """(name of the set, its bands): a band is one number, from the top a hash of the least shingles in its orders (32
    bits), the band of the fingerprint (16 bits) and which of its votes were close (16 bits)."""
    name = xxhash.xxh3_64_intdigest(hashes.tobytes())
    if not len(hashes):
        return name, np.zeros(0, np.uint64)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * LEAST, (1 << 32) - 1, np.uint32)
    for at in range(0, len(short), HASH_BLOCK):
        np.minimum(least, ((short[None, at : at + HASH_BLOCK] ^ _FLIP) * _TIMES).min(axis=1), out=least)
    won = votes(hashes)
    close = _BIT[np.argsort(np.abs(won), axis=1, kind="stable")[:, : turned(len(hashes))]].sum(axis=1)
    both = _mixed((least.reshape(BANDS, LEAST) * _ODD[:LEAST]).sum(axis=1, dtype=np.uint64)) >> np.uint64(32)
    return name, both << np.uint64(32) | ((won > 0) @ _BIT << BITS | close).astype(np.uint64)


def sketched(text: Column | str, words: int = 5) -> Column:
    """Struct of name (long) and bands (array of long, see ``sketch``) of each text's set of shingles."""

    @pandas_udf("name long, bands array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        all_ = [sketch(shingles(t, words)) for t in texts]
        names = np.array([s[0] for s in all_], dtype=np.uint64).view(np.int64)
        return pd.DataFrame({"name": names, "bands": [s[1].view(np.int64) for s in all_]})

    return of(text)


def shingle_column(text: Column | str, words: int = 5) -> Column:
    @pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, words).view(np.int64) for t in texts])

    return of(text)


def banded(nodes: DataFrame) -> DataFrame:
    """(name, least, band): a row for each band of ``nodes`` (name, bands); least is its number and the hash of its least shingles."""
    at = nodes.select("name", F.posexplode("bands").alias("at", "band"))
    return at.select("name", F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.shiftrightunsigned("band", 32)).alias("least"), "band")


def shared(rows: DataFrame) -> DataFrame:
    """The rows of ``banded`` whose least shingles are those of another row too: no other can meet a set, as they are in the keys."""
    return rows.join(rows.groupBy("least").agg(F.count("*").alias("n")).where("n > 1").select("least"), "least").select("name", "least", "band")


def looked_up(rows: DataFrame) -> DataFrame:
    """(name, key) of all that the rows of ``banded`` look up, and are found by: in each band its own value and those of the
    likely ball around it.  A key is the number of the band, the hash of its least shingles and 16 bits."""
    own = F.shiftleft("least", BITS).bitwiseOR(F.shiftrightunsigned("band", BITS).bitwiseAND(F.lit((1 << BITS) - 1)))
    bits = F.array(*[F.lit(1 << i).cast("long") for i in range(BITS)])
    close = F.filter(bits, lambda b: F.col("band").bitwiseAND(b) != 0)
    keys = rows.select("name", own.alias("own"), F.explode(F.concat(F.array(F.lit(0).cast("long")), close)).alias("turned"))
    return keys.select("name", F.col("own").bitwiseXOR(F.col("turned")).alias("key"))


def around(nodes: DataFrame) -> DataFrame:
    """(name, key) of all that the sets of ``nodes`` (name, bands) look up, see ``looked_up``."""
    return looked_up(banded(nodes))


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets (columns name, set) have a true similarity of ``SIMILAR`` (4/5) or more."""
    left, right = sets.select(F.col("name").alias("a"), F.col("set").alias("sa")), sets.select(F.col("name").alias("b"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").where(both * 9 >= (F.size("sa") + F.size("sb")) * 4).select("a", "b")
