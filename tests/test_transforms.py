import numpy as np
import pytest
from pyspark.sql import functions as F
from sigloom.operators import filters, kernels, transforms


@pytest.fixture(scope="module")
def signal(spark):
    rng = np.random.default_rng(3)
    n = 3000
    t = np.arange(n)
    x = 0.5 * np.sin(2 * np.pi * 0.1 * t + 1) + 0.05 * rng.standard_normal(n)
    return x, spark.createDataFrame([(1, int(i), float(v)) for i, v in enumerate(x)], "track long, ix long, x double").cache()


def ordered(df, column="y"):
    return np.array([r[column] for r in df.orderBy("ix").collect()])


def test_high_pass_blocks_do_not_show(signal):
    x, df = signal
    whole, _ = kernels.high_pass(x, 0.05)
    assert np.abs(ordered(filters.high_pass(df, 0.05, block=256)) - whole).max() < 1e-9


def test_high_pass_state_carries(signal):
    x, _ = signal
    whole, _ = kernels.high_pass(x, 0.05)
    a, s = kernels.high_pass(x[:777], 0.05)
    b, _ = kernels.high_pass(x[777:], 0.05, s)
    assert np.array_equal(np.concatenate([a, b]), whole)


def test_tone_is_cancelled_and_blocks_do_not_show(signal):
    x, df = signal
    whole = kernels.cancel_tone(x, 0, 0.1, 40)
    y = ordered(transforms.cancel_tone(df, 0.1, block=512))
    assert np.abs(y - whole).max() < 1e-9
    tone = lambda v: abs(np.exp(-2j * np.pi * 0.1 * np.arange(len(v))) @ v) / len(v)
    assert tone(y) < 0.05 * tone(x)


def test_pops_are_found_and_refilled(spark):
    t = np.arange(2000)
    clean = np.sin(2 * np.pi * 0.013 * t) + 0.001 * np.random.default_rng(1).standard_normal(2000)
    x = clean.copy()
    x[[500, 501, 1200]] += [3.0, -2.0, 4.0]
    y, marks = kernels.repair_pops(x)
    assert marks[[500, 501, 1200]].all() and np.abs(y - clean)[[500, 501, 1200]].max() < 0.05
    df = spark.createDataFrame([(1, int(i), float(v)) for i, v in enumerate(x)], "track long, ix long, x double")
    assert np.abs(ordered(transforms.repair_pops(df, block=700)) - clean).max() < 0.1


def test_suppressor_lowers_noise_more_than_programme(spark):
    rng = np.random.default_rng(2)
    p = rng.exponential(1.0, (200, 5))
    p[100:] *= 1000
    gains = kernels.lsa_suppress(p, np.ones(5))
    assert gains[20:100].mean() < 0.3 < 0.9 < gains[110:].mean()
    df = spark.createDataFrame([(1, i, r.tolist()) for i, r in enumerate(p)], "track long, ix long, p array<double>")
    noise = spark.createDataFrame([(1, [1.0] * 5)], "track long, print array<double>")
    got = np.array([r.gain for r in transforms.suppress(df, noise, block=40, context=40).orderBy("ix").collect()])
    assert np.abs(got - gains.mean(axis=1)).max() < 0.02


def test_exponential_integral_against_quadrature(spark):
    from sigloom.functions.levels import exponential_integral

    x = np.array([0.01, 0.3, 0.99, 1.0, 2.5, 9.0])
    u = np.linspace(0, 60, 600_001)[1:]
    want = [np.sum(np.exp(-v * (1 + u)) / (1 + u)) * (u[1] - u[0]) for v in x[1:]]
    assert kernels._e1(x)[1:] == pytest.approx(want, rel=2e-3)
    got = [r.e for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(exponential_integral(F.col("x")).alias("e")).collect()]
    assert got == pytest.approx(kernels._e1(x).tolist(), rel=1e-9)


def test_warp_recovers_a_shift(spark):
    rng = np.random.default_rng(4)
    a = np.cumsum(rng.standard_normal(300))
    df = spark.createDataFrame([(1, i, float(a[i]), float(a[max(0, i - 5)])) for i in range(300)], "track long, ix long, a double, b double")
    path = transforms.warp(df, size=80, overlap=25, band=12).orderBy("ref").collect()
    proc = [r.proc for r in path]
    assert proc == sorted(proc) and np.median([r.proc - r.ref for r in path]) == 5


def test_lag(spark):
    x = np.random.default_rng(5).standard_normal(400)
    df = spark.createDataFrame([(1, i, float(x[i]), float(x[i - 4]) if i >= 4 else 0.0) for i in range(400)] + [(2, i, 0.0, 0.0) for i in range(5)], "track long, ix long, src double, out double")
    assert {r.track: r.lag for r in transforms.correlation_lag(df, 6).collect()} == {1: 4, 2: 0}


def test_greedy_pick_against_brute_force(spark):
    rng = np.random.default_rng(6)
    level = {t: rng.integers(0, 40, n) / 7 for t, n in ((1, 200), (2, 5), (3, 1))}
    df = spark.createDataFrame([(t, i, float(v)) for t, x in level.items() for i, v in enumerate(x)], "track long, fix long, level double")
    got = sorted((r.track, r.pick, r.fix) for r in transforms.quietest_apart(df, 4, 6).collect())
    want = []
    for t, x in level.items():
        picks = []
        for i in sorted(range(len(x)), key=lambda i: (x[i], i)):
            if len(picks) < 4 and all(abs(i - p) >= 6 for p in picks):
                picks.append(i)
        want += [(t, k, p) for k, p in enumerate(picks)]
    assert got == want


def test_preference_fit_against_gradient(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((400, 2)) * [1, 5]
    y = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] - x[:, 1] / 5)))).astype(float)
    df = spark.createDataFrame([(float(b), float(a[0]), float(a[1])) for a, b in zip(x, y)], "y double, p double, q double")
    w, s = transforms.preference_fit(df, ["p", "q"])
    z = x / np.array(s)
    grad = ((1 / (1 + np.exp(-z @ np.array(w))) - y)[:, None] * z).mean(0) + 0.1 * np.array(w)
    assert np.abs(grad).max() < 1e-8 and w[0] > 0 > w[1]
