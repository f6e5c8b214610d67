"""Hard negatives against all pairs, and the pruning against plain products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from sigloom.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, key string, dim string"


def by_hand(rows, k=5):
    """rows: (vec_id, embedding, label)."""
    whole = set()
    for i, v, lab in rows:
        if i is None or lab is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole.add((i, tuple(math.floor(256 * x) for x in v), (lab + 1) % 10 if i % 7 == 0 else lab))
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    for i, v, lab in whole:
        if i % 100:
            continue
        others = [(j, dot(v, w), m) for j, w, m in whole if j != i and len(w) == len(v)]
        for pid, ps, _ in sorted((o for o in others if o[2] == lab), key=lambda o: (-o[1], o[0]))[:k]:
            fit = sorted((o for o in others if o[2] != lab and 80 * ps <= 100 * o[1] <= 100 * ps), key=lambda o: (-o[1], o[0]))[:k]
            out += [(i, pid, r, o[0], ps, o[1]) for r, o in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(i, v, lab, "clash", "clash") for i, v, lab in rows], SCHEMA)
    return sorted(tuple(r) for r in hard_negatives.mined(df).collect())


def test_against_all_pairs(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.4 * r.normal(size=8)).tolist(), int(i % 6) if i % 5 else int(r.integers(0, 10))) for i in range(700)]
    rows += [(100, rows[3][1], 3), (100, rows[3][1], 3), (100, rows[9][1], 3), (900, [0.0] * 8, 1), (901, [0.0] * 8, 1), (902, [0.0] * 8, 2), (903, [0.0] * 8, 2)]
    rows += [(1000, None, 1), (1001, [None] * 8, 1), (1100, [float("nan")] * 8, 1), (1200, [float("inf")] * 8, 1), (None, rows[0][1], 1), (1300, rows[0][1], None), (1400, [], 1), (1500, [1.0, 2.0], 4), (1501, [1.0, 2.0], 4), (1502, [1.0, 1.9], 5)]
    rows += [(2000 + i, rows[0][1], 7) for i in range(30)] + rows[:20]  # ties and repeats
    got = mined(spark, rows)
    assert got == by_hand(rows) and len(got) > 100


def test_large_components_stay_exact(spark):
    rows = [(0, [1e7, 1.0], 0), (1, [1e7, 2.0], 1), (2, [1e7, 1.5], 2), (3, [1e7, 1.25], 2), (5, [9e6, 0.5], 2)]
    assert mined(spark, rows) == by_hand(rows) != []


def test_blocks_and_shares_do_not_show(spark):
    r = np.random.default_rng(5)
    df = spark.createDataFrame([(i, r.integers(-300, 300, 6).astype(float).tolist(), int(i % 3)) for i in range(300)], "vec_id long, embedding array<double>, label int")
    one = hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0)
    many = hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, block_rows=50, share_rows=7)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_empty_table(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, [1.0], 3)]) == []


@pytest.mark.parametrize("seed", range(4))
def test_pruning_loses_no_row(seed):
    r = np.random.default_rng(seed)
    rows = np.floor(r.normal(size=(2000, 16)) * r.choice([10, 100, 300], size=(2000, 1)))
    rows[:3] = 0
    index = hard_negatives.Buckets(np.arange(2000), np.zeros(2000, np.int64), rows, bucket_rows=128)
    verified = 0
    for q in np.floor(r.normal(size=(20, 16)) * 200):
        scores = rows @ q
        for share in (0.999, 0.99, 0.5):
            least = float(np.quantile(scores, share))
            places, found = index.search(q, lambda p: np.ones(len(p), bool), lambda s: least)  # noqa: B023
            assert sorted(found[found >= least].tolist()) == sorted(scores[scores >= least].tolist())
            verified += len(places) * (share == 0.999)
    assert verified < 20 * 2000 / 2  # far from all rows
