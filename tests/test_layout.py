import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from sigloom.operators import layout, spans


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(layout, "BLOCK", 7)
    monkeypatch.setattr(layout.with_halo, "__defaults__", ("ix", 7))
    monkeypatch.setattr(spans, "BLOCK", 7)


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(1)
    rows = [(k, i, rnd.choice([None, *[round(rnd.uniform(-5, 5), 2) for _ in range(6)]]), rnd.random() < 0.6) for k in (1, 2, 3) for i in range({1: 60, 2: 1, 3: 23}[k])]
    return rows, spark.createDataFrame(rows, "track long, ix long, x double, flag boolean").cache()


def test_numbered(data):
    rows, df = data
    got = {(r.track, r.ix): r.n for r in layout.numbered(df, ["track"], ["ix"], F.floor(F.col("ix") / 5), "n").collect()}
    assert got == {(t, i): i for t, i, _, _ in rows}
    whole = layout.numbered(df, ["track", "flag"], [F.col("ix")], F.floor(F.col("ix") / 5), "n").collect()
    assert all(r.n == sum(1 for t, i, _, f in rows if t == r.track and f == r.flag and i < r.ix) for r in whole)


def test_lagged_crosses_blocks(data):
    rows, df = data
    x = {(t, i): v for t, i, v, _ in rows}
    got = layout.lagged(df, ["track"], a=("x", 3), b=("x", -9)).collect()
    assert len(got) == len(rows) and all(r.a == x.get((r.track, r.ix - 3)) and r.b == x.get((r.track, r.ix + 9)) for r in got)


def test_quantiles(data):
    rows, df = data
    got = {r.track: (r.a, r.b, r.c) for r in layout.quantiles(df, ["track"], "x", a=0.0, b=0.37, c=1.0).collect()}
    for t in {r[0] for r in rows}:
        v = [x for k, _, x, _ in rows if k == t and x is not None]
        if v:
            assert got[t] == pytest.approx(tuple(np.percentile(v, [0, 37, 100])))


def brute_runs(rows):
    out = []
    for t in sorted({r[0] for r in rows}):
        start = None
        flags = [f for k, _, _, f in rows if k == t] + [False]
        for i, f in enumerate(flags):
            if f and start is None:
                start = i
            if not f and start is not None:
                out.append((t, start, i))
                start = None
    return out


def test_runs_merged_isolated_counted(data):
    rows, df = data
    runs = layout.runs(df, ["track"], "flag")
    want = brute_runs(rows)
    assert sorted((r.track, r.start, r.stop) for r in runs.collect()) == want
    joined = []
    for t, a, b in want:
        if joined and joined[-1][0] == t and a - joined[-1][2] < 3:
            joined[-1] = (t, joined[-1][1], b, joined[-1][3] + 1)
        else:
            joined.append((t, a, b, 1))
    assert sorted(map(tuple, layout.merged(runs, ["track"], 3).collect())) == joined
    lone = [(t, a, b) for t, a, b in want if all(t != u or (a, b) == (c, d) or (c - b >= 2 and c >= b) or a - d >= 2 for u, c, d in want)]
    assert sorted(map(tuple, spans.isolated(runs, ["track"], 2).collect())) == lone
    near = sorted((t, a, b, sum(t == u and abs(a - c) <= 10 for u, c, _ in want)) for t, a, b in want)
    assert sorted((r.track, r.start, r.stop, r.around) for r in spans.counted_around(runs, ["track"], 10).collect()) == near


def test_empty(spark):
    none = spark.createDataFrame([], "track long, ix long, x double, flag boolean")
    assert layout.runs(none, ["track"], "flag").collect() == layout.quantiles(none, ["track"], "x", p=0.5).collect() == []
    assert layout.merged(none.selectExpr("track", "ix AS start", "ix AS stop"), ["track"], 3).collect() == []


def test_interpolated_across_cells(spark):
    anchors = [(1, 0, 0.0), (1, 100, 10.0), (1, 400, 40.0), (2, 50, 7.0)]
    points = [(1, t) for t in (-30, 0, 10, 99, 100, 250, 399, 500)] + [(2, 1), (2, 90), (3, 5)]
    got = spans.interpolated(spark.createDataFrame(points, "k long, t long"), spark.createDataFrame(anchors, "k long, t long, v double"), "k", "t", "v", 20).collect()
    have = {(r.k, r.t): r.v for r in got}
    for k, t in points:
        a = [(x, y) for i, x, y in anchors if i == k]
        assert have[k, t] == (pytest.approx(float(np.interp(t, *zip(*a)))) if a else None)


def test_large_keys_are_spread_over_ranges_of_values(spark, monkeypatch):
    """A constant track, one with an outlier, one with many ties, and a small one."""
    monkeypatch.setattr(layout, "SMALL", 50)
    rnd = random.Random(4)
    tracks = {1: [5.0] * 400, 2: [*(rnd.gauss(0, 1) for _ in range(600)), 1e12], 3: [float(rnd.randrange(4)) for _ in range(300)], 4: [1.0, 2.0, 4.0]}
    df = spark.createDataFrame([(t, x) for t, v in tracks.items() for x in v], "track long, x double").repartition(4)
    for p in (0.0, 0.13, 0.5, 0.9, 1.0):
        got = {r.track: r.q for r in layout.quantiles(df, ["track"], "x", q=p).collect()}
        assert got == pytest.approx({t: float(np.percentile(v, 100 * p)) for t, v in tracks.items()})
    nulls = df.selectExpr("nullif(track, 2) AS track", "x", "1 AS k")
    got = {r.track: r.q for r in layout.quantiles(nulls, ["track", "k"], "x", q=0.13).collect()}
    assert got == pytest.approx({(None if t == 2 else t): float(np.percentile(v, 13)) for t, v in tracks.items()})
    large = df.groupBy("track").agg(F.count("*").alias("_n")).where("_n > 50")
    plan = layout._large_quantiles(df.withColumnRenamed("x", "_v"), large, ["track"], {"q": 0.5})._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan
    own = df.where("track = 2").withColumnRenamed("x", "_v")
    cuts = own.agg(F.percentile_approx("_v", [i / 64 for i in range(1, 64)], 10_000)).head()[0]
    sizes = np.bincount(np.searchsorted(cuts, tracks[2], side="left"))
    assert sizes.max() < 40, "the outlier does not push the others into one range"


def test_count_within_an_hour_that_holds_all(spark):
    rnd = random.Random(7)
    events = [rnd.randrange(3600) for _ in range(500)] + [1800] * 400 + [10**7, 10**7 + 3]
    points = [(i, rnd.randrange(3700)) for i in range(200)] + [(500, 1800), (501, 10**7 + 1), (502, -50)]
    got = spans.count_within(spark.createDataFrame(points, "pid long, t long"), spark.createDataFrame([(e,) for e in events], "t long"), "pid", "t", 60, 3600).collect()
    assert {r.pid: r.near for r in got} == {i: sum(abs(e - t) <= 60 for e in events) for i, t in points}


def test_numbered_small_and_large_keys(spark, monkeypatch):
    """Small keys are dealt once and stay dealt by key; large ones are numbered by bucket, with null keys and few rows at once."""
    rows = [(k, i // 3, i % 3) for k, n in ((1, 400), (2, 7), (None, 90)) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, day long, n long").repartition(5)
    small = layout.numbered(df, ["k"], ["day", "n"], F.col("day"))
    assert small.groupBy("k", F.floor(F.col("ix") / 8)).count()._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = sorted((str(k), d, n, 3 * d + n) for k, d, n in rows)
    assert sorted((str(r.k), r.day, r.n, r.ix) for r in small.collect()) == want
    monkeypatch.setattr(layout, "SMALL", 50)
    assert sorted((str(r.k), r.day, r.n, r.ix) for r in layout.numbered(df, ["k"], ["day", "n"], F.col("day")).collect()) == want
    assert layout.numbered(df.limit(0), ["k"], ["day", "n"], F.col("day")).collect() == []


def test_a_table_of_few_keys_is_sent_to_the_rows(spark, monkeypatch):
    df = spark.range(1000).selectExpr("id % 3 AS k", "id AS x")
    per = df.groupBy("k").agg(F.max("x").alias("m"))
    joined = layout.beside(df, per, ["k"])
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 1000
    monkeypatch.setattr(layout, "FEW", 2)
    assert layout.beside(df, per, ["k"]).where("m >= 997").count() == 1000


def test_quantiles_of_counted_values(spark, monkeypatch):
    """Values with how often they occur give the quantiles of all rows, for keys below and above the bound."""
    rnd = random.Random(9)
    tracks = {1: [float(rnd.randrange(5)) for _ in range(300)], 2: [rnd.gauss(0, 1) for _ in range(30)], None: [1.0, 1.0, 3.0]}
    df = spark.createDataFrame([(t, x) for t, v in tracks.items() for x in v], "track long, x double").repartition(4)
    for bound in (layout.SMALL, 50):
        monkeypatch.setattr(layout, "SMALL", bound)
        c = layout.counted(df, ["track"], "x")
        assert c.where("track = 1").count() == 5
        rows = layout.quantiles(c, ["track"], "x", "_c", a=0.13, b=0.9).collect()
        for name, p in (("a", 13), ("b", 90)):
            assert {r.track: r[name] for r in rows} == pytest.approx({t: float(np.percentile(v, p)) for t, v in tracks.items()})


def test_blocks_and_their_halos(spark):
    df = spark.createDataFrame([(t, i, float(100 * t + i)) for t, n in ((1, 23), (2, 8), (3, 1)) for i in range(n)], "track int, ix long, x double").repartition(3)
    blocks = layout.blocked(df, "x", block=4)
    assert sorted(map(tuple, layout.unblocked(blocks, "x").collect())) == sorted(map(tuple, df.collect()))
    for before, after in ((0, 0), (1, 0), (0, 3), (6, 9)):
        for r in layout.haloed(blocks, before, after, "x", block=4).collect():
            n = {1: 23, 2: 8, 3: 1}[r.track]
            low, high = max(r.blk * 4 - before, 0), min((r.blk + 1) * 4 + after, n)
            assert r.first == low and r["at"] == r.blk * 4 - low and r.n == min(4, n - r.blk * 4) and r.x == [100.0 * r.track + i for i in range(low, high)]
