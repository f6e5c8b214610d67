"""Derived gates, floors of pairs, models across groups and settings as maps."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from sigloom.functions import maps
from sigloom.operators import calibration


def test_gates_tighten_only_with_verdicts(spark):
    gates = spark.createDataFrame([("a", "m1", "<=", 2.0), ("b", "m1", "<=", 2.0), ("c", "m1", "<=", 2.0), ("d", "m2", ">=", -1.0), ("e", "m2", ">=", -5.0), ("f", "none", "<=", 1.0), ("g", "m1", "<=", None), ("h", "m1", "<=", 0.1)], "gate string, metric string, op string, threshold double")
    floors = spark.createDataFrame([("m1", 0.5), ("m2", 1.0), ("m3", None)], "metric string, spread double")
    judged = [("a", "good", 1.0), ("a", "good", 0.2), ("a", "bad", 4.0), ("a", "bad", 9.0), ("a", "neither", 100.0), ("b", "good", 3.0), ("b", "bad", 3.5), ("c", "good", 1.0), ("c", "bad", None), ("d", "good", -3.0), ("d", "good", None)]
    got = {r.gate: (r.threshold, r.source, r.n_verdicts) for r in calibration.derived_gates(gates, floors, spark.createDataFrame(judged, "gate string, side string, value double")).collect()}
    assert got == {
        "a": (2.5, "known ordering", 4), "b": (4.5, "known good bound", 1), "c": (2.0, "floor", 0), "d": (-6.0, "known good bound", 1), "e": (-5.0, "floor", 0), "h": (1.5, "floor", 0),
    }


def test_pair_floor_is_exact_for_small_groups_and_bounded_for_large(spark):
    r = np.random.default_rng(2)
    rows = [(i, "small", r.normal(size=8).tolist()) for i in range(15)] + [(100 + i, "large", (r.normal(size=8) + 1).tolist()) for i in range(600)]
    rows += [(900, "lone", [1.0] * 8), (901, "zero", [0.0] * 8), (902, "zero", [1.0] * 8), (903, "odd", [1.0, 2.0]), (904, "odd", [1.0]), (905, None, [1.0]), (906, "small", None)]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>").repartition(3)
    got = {g.label: g for g in calibration.pair_floor(df, "label").collect()}
    v = np.array([x for _, k, x in rows if k == "small" and x])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    every = (v @ v.T)[np.triu_indices(15, 1)]
    assert got["small"].pairs == 105 and got["small"].floor == pytest.approx(np.percentile(every, 10), abs=1e-12)
    assert got["large"].n == 600 and got["large"].pairs == 600 * 16 - sum(range(17))
    w = np.array([x for _, k, x in rows if k == "large"])
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    assert got["large"].floor == pytest.approx(np.percentile((w @ w.T)[np.triu_indices(600, 1)], 10), abs=0.05)
    assert set(got) == {"small", "large"}


def test_cross_validation_against_fits_one_by_one(spark):
    r = np.random.default_rng(4)
    n = 400
    x = r.normal(size=(n, 2)) * [1.0, 20.0]
    y = (r.uniform(size=n) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - 0.05 * x[:, 1])))).astype(float)
    group = [f"g{i % 23}" for i in range(n)]
    df = spark.createDataFrame([(g, float(a), float(b), float(t)) for g, (a, b), t in zip(group, x, y, strict=True)], "g string, a double, b double, y double")
    df = df.union(spark.createDataFrame([("g1", 1.0, 1.0, None)], df.schema))
    got = {c.fold: c for c in calibration.cross_validated(df, ["a", "b"], F.col("g"), folds=4).collect()}
    fold = {c.g: c.f for c in df.select("g", F.pmod(F.xxhash64("g"), F.lit(4)).alias("f")).distinct().collect()}
    own = np.array([fold[g] for g in group])
    z = x / np.sqrt((x**2).mean(axis=0))
    for k in range(4):
        w = np.zeros(2)
        tr = own != k
        for _ in range(50):
            p = 1 / (1 + np.exp(-z[tr] @ w))
            w -= np.linalg.solve((z[tr].T * (p * (1 - p))) @ z[tr] / tr.sum() + 0.1 * np.eye(2), z[tr].T @ (p - y[tr]) / tr.sum() + 0.1 * w)
        p = 1 / (1 + np.exp(-z[~tr] @ w))
        assert got[k].weights == pytest.approx(w.tolist(), abs=1e-8) and got[k].n == (~tr).sum()
        assert got[k].log_loss == pytest.approx(float(-(y[~tr] * np.log(p) + (1 - y[~tr]) * np.log(1 - p)).mean()), abs=1e-9)
    assert sum(c.log_loss * c.n for c in got.values()) / n < math.log(2) * 0.9


def test_settings_split_and_put_back(spark):
    docs = ['{"engine": {"gain": 1.5, "bands": [1, {"a": 2}], "deep": {"x": null}}, "mode": "auto", "none": {}}', "{}", "broken", "[1]", None, '{"engine": "plain"}', '{"ü": {"k": "Ä"}}']
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, d string").select("i", maps.flattened("d").alias("m"))
    out = df.select("i", "m", maps.nested("m").alias("back"), maps.nested(maps.overlaid(maps.outside("m", "engine"), maps.rooted(maps.under("m", "engine"), "engine"))).alias("again"), maps.under("m", "engine").alias("e")).orderBy("i").collect()
    for r, d in zip(out, docs, strict=True):
        if r.m is None:
            assert d in ("broken", "[1]", None) and r.back is None
        else:
            assert json.loads(r.back) == json.loads(d) == json.loads(r.again)
    assert out[0].e == {"gain": "1.5", "bands": '[1, {"a": 2}]', "deep.x": "null"}


def test_changed_settings(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2", "c": "3"}, {"a": "1", "b": "9"})], "m map<string,string>, b map<string,string>")
    assert df.select(maps.changed("m", "b")).head()[0] == {"b": "2", "c": "3"}
    assert df.select(maps.overlaid("b", maps.changed("m", "b"))).head()[0] == {"a": "1", "b": "2", "c": "3"}
