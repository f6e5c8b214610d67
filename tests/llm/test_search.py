import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from sigloom.llm import bitsliced, blocks, collision

NAN, INF = math.nan, math.inf
ODD = [(0, [1.0, 0.5]), (20, [1.0, 0.5]), (20, [0.5, 0.25]), (40, [0.0, 0.0]), (60, None), (80, [1.0, None]), (None, [1.0, 1.0]), (100, [NAN, 1.0]), (120, [INF, 1.0]), (140, []), (160, [1.0, 2.0, 3.0]), (1, [1.0, 0.5]), (2, [-1.0, 0.25]), (3, [1.0, 0.5]), (4, [2.0, 0.25]), (-20, [0.25, 0.25])]
SCHEMA = "vec_id long, embedding array<float>, score string, rank int, dim int, v int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in ODD], SCHEMA)


def brute(rows, score, k, zero):
    """Every row is a candidate; of rows that repeat an id each different vector asks."""
    ok = [(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))]
    out = []
    for q, v in {(i, v) for i, v in ok if i % 20 == 0}:
        c = sorted((-score(v, w), i) for i, w in ok if i != q and len(w) == len(v))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(c)]
    return sorted(out)


def inner(a, b):
    return sum(x * y for x, y in zip(a, b))


def quantised(a, b):
    return sum(math.floor(64 * x) * math.floor(64 * y) for x, y in zip(a, b))


def test_odd_rows(odd):
    assert sorted(map(tuple, collision.nearest(odd, k=3).collect())) == brute(ODD, inner, 3, False)
    assert sorted(map(tuple, bitsliced.top_k(odd, k=3).collect())) == brute(ODD, quantised, 3, True)
    assert collision.nearest(odd.limit(0)).collect() == bitsliced.top_k(odd.limit(0)).collect() == []


def test_blocks_do_not_change_the_exact_search(spark, sf, monkeypatch):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute(rows, quantised, 20, True)
    assert sorted(map(tuple, bitsliced.top_k(df).collect())) == want
    monkeypatch.setattr(blocks, "SHARE_ROWS", 3)
    assert sorted(map(tuple, bitsliced.top_k(df, block_rows=60).collect())) == want
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # several partitions, each with some of the blocks
    try:
        assert sorted(map(tuple, bitsliced.top_k(df, block_rows=60).collect())) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_recall_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    r = df.orderBy("vec_id").collect()
    ids, x = np.array([a.vec_id for a in r]), np.array([a.embedding for a in r], dtype=float)
    hits = total = 0
    got = {}
    for a in collision.nearest(df).collect():
        got.setdefault(a.query_id, {})[a.vec_id] = a.score
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        want = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        mine = got[int(ids[i])]
        assert len(mine) == 20 and all(abs(v - float(x[np.searchsorted(ids, k)] @ x[i])) < 1e-12 for k, v in mine.items())
        hits, total = hits + len(want & mine.keys()), total + 20
    assert hits / total >= 0.93


def test_many_equal_vectors_tie_by_id():
    rng = np.random.default_rng(0)
    ids = np.arange(3000)
    x = rng.standard_normal((3000, 16))
    x[500:2500] = x[7]
    got, scores, _ = collision.Index(ids, x).search(7, x[7], 20)
    order = np.lexsort((got, -scores))[:20]
    s = (x * x[7]).sum(axis=1)
    s[7] = -np.inf
    assert got[order].tolist() == np.lexsort((ids, -s))[:20].tolist()
    v = np.floor(64 * x).astype(np.int64)
    got, scores = bitsliced.SlicedIndex(ids, v).top(7, v[7], 20)
    e = v @ v[7]
    e[7] = -(10**9)
    assert set(got.tolist()) == set(np.lexsort((ids, -e))[:20].tolist())


def test_lengths_differ_and_large_values():
    rng = np.random.default_rng(1)
    ids, x = np.arange(2000), rng.standard_normal((2000, 8)) * rng.uniform(0.1, 30, (2000, 1)) * 1e150
    index, hits = collision.Index(ids, x), 0
    for q in range(0, 2000, 50):
        got, scores, _ = index.search(q, x[q], 10)
        s = (x / 1e150) @ (x[q] / 1e150)
        s[q] = -np.inf
        hits += len(set(got[np.lexsort((got, -scores))[:10]].tolist()) & set(np.argsort(-s)[:10].tolist()))
    assert hits / 400 > 0.9


def test_threshold_bounds_the_chance_to_miss():
    rng = np.random.default_rng(2)
    hits = (np.abs(rng.standard_normal((4000, 64))) < 1).sum(axis=1)
    assert (hits < collision._threshold(64, 0.05)).mean() < 0.06


def test_blocks_just_under_a_multiple_of_the_block_rows(spark):
    n = 2 * collision.BLOCK_ROWS - 2
    df = spark.range(n).select(F.col("id").alias("vec_id"), F.array(*[F.rand(s) - 0.5 for s in range(4)]).alias("embedding")).checkpoint()
    x = np.array([r.embedding for r in df.orderBy("vec_id").collect()])
    query = F.col("vec_id").isin(0, 20)
    for rows in (collision.BLOCK_ROWS, 2 * n):  # in the second all rows are in one block larger than 2^16
        got = collision.nearest(df, query, k=10, block_rows=rows).collect()
        hits = 0
        for q in (0, 20):
            s = x @ x[q]
            s[q] = -np.inf
            hits += len({r.vec_id for r in got if r.query_id == q} & set(np.argsort(-s)[:10].tolist()))
        assert len(got) == 20 and hits >= 18


def test_repeated_rows_and_ids(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in np.round(rng.standard_normal(3), 2)]) for i in rng.integers(0, 60, 300)] + [(7, [1.0, 1.0, 1.0])] * 400
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    for search, score, zero in ((bitsliced.top_k, quantised, True), (collision.nearest, inner, False)):
        for size in (65536, 40):
            got = sorted((*r[:3], round(r[3], 9)) for r in search(df, k=6, block_rows=size).collect())
            want = sorted((*r[:3], round(r[3], 9)) for r in brute(rows, score, 6, zero))
            assert len(got) == len(want)
            both = Counter((r[0], *r[2:]) for r in got) & Counter((r[0], *r[2:]) for r in want)
            assert got == want if zero else both.total() >= 0.9 * len(want)


def test_large_components(spark):
    probe = [(0, [5e6, 1.0]), (20, [1.0, 2.0]), (1, [1.0, 1.0]), (2, [6e6, 1.0])]
    wide = [(40 * i, [float(2**i), 1.0, -(2.0**-i)]) for i in range(24)] + [(3, [float(2**24), 0.0, 1.0])]
    huge = [(0, [1e-9, 0.0]), (1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [float(2**70), 1.0])]
    for rows in (probe, wide, huge):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        exact = lambda a, b: sum(math.floor(64 * x) * math.floor(64 * y) if abs(x) < 1e290 and abs(y) < 1e290 else 64 * int(x) * math.floor(64 * y) if abs(x) >= 1e290 else 64 * int(y) * math.floor(64 * x) for x, y in zip(a, b))
        assert sorted(map(tuple, bitsliced.top_k(df, k=3).collect())) == brute(rows, exact, 3, True)
    with pytest.raises(Exception, match="does not fit a long"):
        bitsliced.top_k(spark.createDataFrame([(0, [1e30]), (1, [1e30])], "vec_id long, embedding array<double>")).collect()


def test_sql_keeps_repeated_rows(spark):
    import duckdb
    from sigloom.llm import queries

    rows = [(0, [1.0, 0.5]), (20, [1.0, 0.5]), (20, [0.5, 0.25]), (20, [0.5, 0.25]), (1, [5e6, 1.0]), (1, [5e6, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    c = duckdb.connect()
    c.register("embeddings", df.toPandas())
    assert sorted(map(tuple, bitsliced.top_k(df).collect())) == sorted(c.sql(queries.OP4_SQL).fetchall())


def test_blocks_follow_the_length_of_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.standard_normal(200 if i % 3 else 5)]) for i in range(240)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = blocks.usable(df, False)

    def build(ids, m):
        assert m.size <= 4 * 2048, "a block holds about as many components as it may"
        return ids, m

    got = blocks.best(vectors, F.col("vec_id") % 20 == 0, 5, 65536, build, lambda b, q, v: (np.flatnonzero(b[0] != q), (b[1] @ v)[b[0] != q]), "double", cells=2048).collect()
    assert [(r.query_id, r.vec_id) for r in sorted(got, key=lambda r: (r.query_id, r.rank))] == [(q, i) for q, _, i, _ in brute(rows, inner, 5, True)]
