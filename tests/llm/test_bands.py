import random

import numpy as np
from sigloom.llm import shingles


def slow_votes(hashes):
    """Votes for and against each bit of the fingerprint, one shingle and bit at a time."""
    out = []
    for word in shingles._WORDS:
        mixed = [int(shingles._mixed(np.array([h ^ word]))[0]) for h in hashes]
        out += [sum(1 if m >> b & 1 else -1 for m in mixed) for b in range(64)]
    return out[: shingles.BANDS * shingles.BITS]


def looked_up(spark, sets):
    """Keys of each set by its place in ``sets``."""
    rows = [(i, [v - (1 << 64) if v >> 63 else v for v in shingles.sketch(s)[1].tolist()]) for i, s in enumerate(sets)]
    keys = {i: set() for i in range(len(sets))}
    for r in shingles.around(spark.createDataFrame(rows, "name long, bands array<long>")).collect():
        keys[r["name"]].add(r["key"])
    return keys


def test_keys_are_the_likely_balls_around_bands(spark):
    """Own value of a band and those with one close vote turned, and none beside them."""
    texts = ["", "one two", "a b c d e f g h", " ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(90))]
    sets = [shingles.shingles(t) for t in texts]
    keys = looked_up(spark, sets)
    assert keys[0] == set()
    for i, s in enumerate(sets[1:], 1):
        votes = slow_votes(s)
        assert shingles.votes(s).reshape(-1).tolist() == votes
        want = {}
        for band in range(shingles.BANDS):
            own = votes[band * 16 : band * 16 + 16]
            value = sum(1 << b for b in range(16) if own[b] > 0)
            close = sorted(range(16), key=lambda b: (abs(own[b]), b))[: shingles.turned(len(s))]
            want[band] = {value, *(value ^ 1 << b for b in close)}
        assert {b: {k & 0xFFFF for k in keys[i] if k >> 48 == b} for b in range(shingles.BANDS)} == want
        assert len({(k >> 48, k >> 16 & 0xFFFFFFFF) for k in keys[i]}) == shingles.BANDS  # one least shingle a band


def test_long_sets_vote_in_blocks(monkeypatch):
    hashes = shingles.shingles(" ".join(f"w{i}" for i in range(5000)))
    whole = shingles.sketch(hashes)
    monkeypatch.setattr(shingles, "HASH_BLOCK", 100)
    assert (shingles.sketch(hashes)[1] == whole[1]).all() and len(hashes) > 2048


def test_sets_at_the_bound_meet_and_strangers_do_not(spark):
    """Similarity of exactly 0.8: sets of 4 to 400 shingles that differ on one side or on both."""
    rnd, sets = np.random.default_rng(11), []
    for common, more, other in [(4, 1, 0), (8, 1, 1), (12, 1, 2), (16, 4, 0), (40, 5, 5), (80, 20, 0), (200, 25, 25), (400, 50, 50)] * 40:
        drawn = rnd.integers(0, 1 << 64, common + more + other, dtype=np.uint64)
        sets += [np.sort(drawn[: common + more]), np.sort(np.concatenate([drawn[:common], drawn[common + more :]]))]
    keys = looked_up(spark, sets)
    assert all(keys[i] & keys[i + 1] for i in range(0, len(sets), 2))
    order = list(range(0, len(sets), 2))
    random.Random(2).shuffle(order)
    assert not any(keys[a] & keys[b] for a, b in zip(order, order[1:], strict=False))
