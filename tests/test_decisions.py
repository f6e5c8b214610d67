"""Thresholds, protected gates, vetoes, refusals and rewards on small cases worked out by hand."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F
from sigloom.operators import decisions, scoring

FLAT = "tape int, candidate string, reading string, value double"
NAN = float("nan")


def test_rollup_over_all_and_by_tape(spark):
    rows = [(t, "c", "r", float(x)) for t, xs in ((1, [1, 2, 9]), (2, [4]), (None, [5])) for x in xs] + [(1, "c", "r", None), (1, "c", "r", NAN)]
    got = {(r.whole, r.tape): (r.median, r.p10, r.n) for r in decisions.rollup(spark.createDataFrame(rows, FLAT)).collect()}
    assert got == {(True, None): (4.0, pytest.approx(1.4), 5), (False, 1): (2.0, None, 3), (False, 2): (4.0, None, 1), (False, None): (5.0, None, 1)}


def test_a_baseline_excuses_failures(spark):
    rows = [("base", "a", True), ("base", "b", True), ("base", "b", True), ("x", "a", True), ("x", "b", True), ("y", "a", True), ("y", "b", True), ("y", "c", True), ("z", "c", False), ("z", "d", None)]
    f = spark.createDataFrame(rows, "candidate string, excerpt string, failed boolean")
    of = lambda *a: {r.candidate: (r.failed, r.vetoed) for r in decisions.excused(f, *a).collect()}
    assert of("base") == {"base": (2, False), "x": (2, False), "y": (3, True), "z": (0, False)}
    assert of("nobody", 1) == {"base": (2, True), "x": (2, True), "y": (3, True), "z": (0, False)}
    assert of("base", 5)["y"] == (3, False)


def test_thresholds_from_floors(spark):
    rows = [("floor", 0.4), ("floor-0.1", 0.4), ("floor+1", 0.4), ("0.7", None), ("floor", None), (None, 1.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, f double").select(decisions.threshold_of(F.col("t"), F.col("f"))).collect()]
    assert got[:2] == pytest.approx([0.4, 0.3]) and got[2:] == [1.4, 0.7, None, None]


def test_protected_gates(spark):
    kinds = "gate string, metric string, op string, threshold double, severity string"
    gates = [("a", "m", "<=", 2.0, "hard"), ("b", "m", ">=", 2.0, "hard"), ("c", "m", "abs<=", 2.0, "hard"), ("d", "m", "<=", 2.0, "soft"), ("e", "m", "<=", 2.0, "soft"), ("f", "m", "<=", 2.0, "soft"), ("g", "m", "<=", None, "soft")]
    fresh = [
        ("a", None, None, 1.0, None, 0, "floor"), ("b", None, None, 1.0, None, None, "floor"), ("c", None, None, -3.0, None, 0, "floor"), ("d", None, None, 1.0, "hard", 2, "floor"),
        ("e", "n", ">=", 9.0, "hard", 5, "ear"), ("new", "k", ">=", 1.0, "soft", 0, "floor"), ("old", "k", ">=", 1.0, "soft", 0, None), ("g", None, None, 4.0, None, 0, "floor"),
    ]
    p = decisions.protected(spark.createDataFrame(gates, kinds), spark.createDataFrame(fresh, kinds + ", n_verdicts int, source string"), fixed=["e", "new"], display=["d"], retired=["old", "a"])
    assert {r.gate: (r.metric, r.op, r.threshold, r.severity, r.calibrated) for r in p.collect()} == {
        "a": ("m", "<=", 2.0, "hard", False), "b": ("m", ">=", 1.0, "hard", False), "c": ("m", "abs<=", 3.0, "hard", False), "d": ("m", "<=", 1.0, "soft", True),
        "e": ("m", "<=", 2.0, "soft", False), "f": ("m", "<=", 2.0, "soft", False), "g": ("m", "<=", 4.0, "soft", False), "new": ("k", ">=", 1.0, "soft", False),
    }
    assert {r.gate for r in decisions.protected(spark.createDataFrame(gates, kinds), spark.createDataFrame([], kinds + ", n_verdicts int, source string")).collect()} == set("abcdefg")


def test_vetoes(spark):
    flat = [(1, "i", "r", 1.0), (1, "x", "r", 1.4), (1, "y", "r", 1.6), (1, "z", "r", NAN), (2, "i", "r", NAN), (2, "x", "r", 99.0), (1, "i", "s", 1.0), (1, "x", "s", 0.0), (1, "y", "s", 3.0)]
    rules = spark.createDataFrame([("r", "up", 5.0), ("s", "down", 5.0)], "reading string, worse string, multiple double")
    floors = spark.createDataFrame([("r", 0.1), ("s", 0.1)], "reading string, floor double")
    steps = decisions.against(spark.createDataFrame(flat, FLAT), "i", decisions.limited(rules, floors))
    got = {(r.tape, r.candidate, r.reading): r.vetoed for r in decisions.vetoed(steps).collect()}
    assert got == {(1, "x", "r"): False, (1, "y", "r"): True, (1, "z", "r"): True, (1, "x", "s"): True, (1, "y", "s"): False, (1, "z", "s"): True}  # tape 2: the incumbent has no reading
    for bad in ([("r", 0.1)], [("r", 0.1), ("s", 0.0)], [("r", 0.1), ("s", NAN)]):
        with pytest.raises(Exception, match="no floor above nought"):
            decisions.limited(rules, spark.createDataFrame(bad, "reading string, floor double")).collect()


def judged_family(moves, limits, jitter, alpha):
    """moves: reading -> moves for the worse of one candidate (None: lost)."""
    rows, p = {}, {}
    for r, ms in moves.items():
        worse, better = sum(m is None or m > jitter for m in ms), sum(m is not None and m < -jitter for m in ms)
        n = worse + better
        p[r] = 1.0 if n == 0 else sum(math.comb(n, k) for k in range(worse, n + 1)) / 2**n
        rows[r] = (len(ms), worse, better, sum(m is None or m > limits[r] for m in ms))
    rejected = set()
    for i, (r, v) in enumerate(sorted(p.items(), key=lambda kv: (kv[1], kv[0]))):
        if v > alpha / (len(p) - i):
            break
        rejected.add(r)
    few = decisions.resolvable(len(moves), alpha)
    return {r: (*c, c[3] >= math.ceil(c[0] / 3) and (r in rejected if c[0] >= few else c[1] == c[0])) for r, c in rows.items()}


def test_family_vetoes_against_one_by_one(spark):
    rnd = random.Random(4)
    limits = {"a": 0.5, "b": 1.0, "c": 0.2}
    for clips in (3, 9):
        all_ = {c: {r: [rnd.choice([None, *[rnd.gauss(m, 1) for _ in range(5)]]) for _ in range(clips)] for r in limits} for c, m in (("x", 2.0), ("y", 0.0), ("z", -2.0))}
        all_["w"] = {r: [3.0] * clips for r in limits}
        rows = [(t, c, r, limits[r], m) for c, rs in all_.items() for r, ms in rs.items() for t, m in enumerate(ms)]
        steps = spark.createDataFrame(rows, "tape int, candidate string, reading string, limit double, step double")
        got = {(r.candidate, r.reading): (r.clips, r.worse, r.better, r.past, r.vetoed) for r in decisions.family_vetoes(steps, 0.1).collect()}
        assert got == {(c, r): v for c, rs in all_.items() for r, v in judged_family(rs, limits, 0.1, 0.05).items()}
        assert all(got["w", r][4] for r in limits)


def test_refused_settings(spark):
    s = spark.createDataFrame([("x", "gain", 5.0), ("y", "gain", 4.9), ("z", "gain", NAN), ("x", "cut", 1.0), ("y", "cut", 3.0), ("x", "new", -2.0), ("y", "free", 9.0)], "candidate string, key string, value double")
    now = spark.createDataFrame([("gain", 4.0), ("cut", 1.0)], "key string, value double")
    rules = spark.createDataFrame([("gain", 5.0, 1.0), ("cut", 2.0, -1.0), ("cut", 3.0, 1.0), ("new", -1.0, -1.0)], "key string, bound double, side double")
    assert {(r.candidate, r.key, r.bound) for r in decisions.refused(s, now, rules).collect()} == {("x", "gain", 5.0), ("y", "cut", 3.0), ("x", "new", -1.0)}  # x, cut: stands where the incumbent stands


def test_statuses(spark):
    rows = [(1, "".join("01"[b] for b in bits), *bits) for bits in itertools.product([False, True], repeat=6)] + [(2, "none", *[None] * 6)]
    kinds = "tape int, candidate string, " + ", ".join(f"{c} boolean" for c in decisions.CHECKS)
    for r in decisions.statuses(spark.createDataFrame(rows, kinds)).collect():
        on = {c for c, b in zip(decisions.CHECKS, r.candidate) if b == "1"} if r.tape == 1 else set()
        assert r.status == ("excluded" if on & set(decisions.PUT_OUT) else "tie" if "inaudible" in on else "capped" if on else "ok")


def test_rewards_compare_only_who_is_in(spark):
    kinds = "reading string, ix int, family string, target double, dead_zone double, scale double, weight double, tie double"
    grid = spark.createDataFrame([("r", 0, "f", 0.0, 0.0, 1.0, 1.0, 0.1), ("s", 1, "g", 0.0, 0.0, 1.0, 1.0, 0.0)], kinds)
    flat = [(1, c, r, x) for c, xs in {"a": (1.0, 1.0), "b": (2.0, 2.0), "c": (0.5, 0.5), "out": (0.0, 0.0), "same": (0.1, 0.1), "lost": (1.5, None)}.items() for r, x in zip("rs", xs)]
    flat += [(2, "alone", "r", 1.0), (2, "alone", "s", 1.0)]
    dist = scoring.distances(spark.createDataFrame(flat, FLAT), grid)
    st = spark.createDataFrame([(1, "a", "ok"), (1, "b", "ok"), (1, "c", "capped"), (1, "out", "excluded"), (1, "same", "tie"), (1, "lost", "ok"), (2, "alone", "ok")], "tape int, candidate string, status string")
    got = {r.candidate: (r.status, r.family, pytest.approx(r.reward), r.may_win) for r in decisions.rewards(dist, st).collect()}
    assert got == {
        "a": ("ok", "f", 2 / 3, True), "b": ("ok", "f", 0.0, True), "c": ("capped", "f", 0.5, False), "out": ("excluded", None, 0.0, False), "same": ("tie", None, 0.5, False),
        "lost": ("ok", "g", 0.0, True), "alone": ("unrated", None, 0.5, False),
    }


def test_loudness_stage(spark):
    rows = [(-20.0, -6.0, 5.0, 60.0), (-20.0, -4.0, 5.0, 60.0), (-20.0, -4.0, 25.0, 60.0), (-20.0, -5.0, 20.0, None), (-20.0, 0.0, 30.0, 2.9), (0.0, -6.0, 5.0, 60.0), (None, -6.0, 5.0, 60.0), (-20.0, NAN, 5.0, 0.0), (-10.0, 0.0, 25.0, 60.0)]
    b = decisions.linear_blockers(F.col("i"), F.col("p"), F.col("r"), F.col("s"))
    got = [(list(r.b), r.how) for r in spark.createDataFrame(rows, "i double, p double, r double, s double").withColumn("b", b).withColumn("how", decisions.stage(F.col("b"), F.col("i"))).collect()]
    assert got == [([], "linear"), (["true peak"], "limited"), (["range", "true peak"], "dynamic"), ([], "linear"), ([], "linear"), (["unreadable"], "dynamic"), (["unreadable"], "dynamic"), (["unreadable"], "dynamic"), (["range"], "dynamic")]
