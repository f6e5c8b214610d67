"""Events and their gains, injected defects, on planted signals."""

import functools
import numpy as np
import pytest
from pyspark.sql import functions as F
from sigloom.operators import defects, events

RATE = 8000


def frame(spark, x, track=1):
    return spark.createDataFrame([(track, i, float(v)) for i, v in enumerate(x)], "track long, ix long, x double").repartition(4)


def ordered(df, column):
    return np.array([r[column] for r in sorted(df.collect(), key=lambda r: r.ix)])


def test_plosives_are_tamed_and_nothing_else(spark):
    r, n = np.random.default_rng(3), 8 * RATE
    t = np.arange(n) / RATE
    x = 0.01 * r.normal(size=n)
    bursts = [2 * RATE, 5 * RATE]
    for at in bursts:  # 60 ms at 60 Hz, sharp onset
        k = np.arange(int(0.06 * RATE))
        x[at : at + len(k)] += 0.5 * np.exp(-k / (0.025 * RATE)) * np.sin(2 * np.pi * 60 * k / RATE)
    x[int(3.5 * RATE) : int(3.7 * RATE)] += 0.3 * np.sin(2 * np.pi * 1000 * t[: int(0.2 * RATE)])  # a voice is no burst
    df = frame(spark, x)
    found = sorted(map(tuple, events.plosives(df, RATE, hop=64).select("start", "stop", "excess_db").collect()))
    assert len(found) == 2 and all(abs(s - at) <= 256 for (s, _, _), at in zip(found, bursts, strict=True))
    ev = spark.createDataFrame([(1, s, e, d) for s, e, d in found], "track long, start long, stop long, excess_db double")
    y = ordered(events.tamed(df, ev, RATE, taps=255), "y")
    away = np.ones(n, bool)
    for s, e, _ in found:
        away[s - 50 : e + 50] = False
    assert np.abs(y - x)[away].max() < 1e-12
    for at in bursts:
        assert np.abs(y[at : at + 200]).max() < 0.5 * np.abs(x[at : at + 200]).max()
    assert np.abs(ordered(events.tamed(df, ev, RATE, taps=255, block=700), "y") - y).max() < 1e-9


def test_rhythm_and_neighbours_are_left_alone(spark):
    n = 12 * RATE
    x = 0.01 * np.random.default_rng(4).normal(size=n)
    k = np.arange(int(0.05 * RATE))
    burst = 0.5 * np.exp(-k / (0.02 * RATE)) * np.sin(2 * np.pi * 60 * k / RATE)
    for at in range(RATE, n - RATE, RATE // 2):
        x[at : at + len(k)] += burst
    assert events.plosives(frame(spark, x), RATE, hop=64).count() == 0
    y = 0.01 * np.random.default_rng(4).normal(size=n)
    for at in (5 * RATE, 5 * RATE + RATE // 6):
        y[at : at + len(k)] += burst
    assert events.plosives(frame(spark, y), RATE, hop=64).count() == 0


def test_sibilants_get_their_source_back(spark):
    r, n, rate = np.random.default_rng(5), 4 * 16000, 16000
    src = 0.002 * r.normal(size=n)
    hiss = r.normal(size=2000)
    hiss = np.diff(hiss, prepend=0)
    src[20_000:22_000] += 0.2 * hiss
    src[40_000:44_000] += 0.3 * np.sin(2 * np.pi * 300 * np.arange(4000) / rate)
    out = src * 0.5
    source, restored = frame(spark, src), frame(spark, out)
    found = [tuple(x) for x in events.sibilants(source, rate, hop=128).select("start", "stop").collect()]
    assert len(found) == 1 and abs(found[0][0] - 20_000) <= 128 and abs(found[0][1] - 22_000) <= 256
    ev = spark.createDataFrame([(1, *found[0])], "track long, start long, stop long")
    y = ordered(events.guarded(restored, source, ev, rate, mix=1.0, taps=255), "y")
    high = slice(20_400, 21_600)
    assert np.std(y[high]) > 1.5 * np.std(out[high]) and np.abs(y - out)[:19_000].max() < 1e-12 and np.abs(y - out)[30_000:].max() < 1e-12


def test_weights_do_not_show_blocks(spark):
    df = frame(spark, np.zeros(3000))
    ev = spark.createDataFrame([(1, 95, 130, 0.5), (1, 120, 400, 0.25), (1, 2990, 3000, 1.0)], "track long, start long, stop long, depth double")
    a, b = ordered(events.weights(df, ev, 40), "w"), ordered(events.weights(df, ev, 40, block=100), "w")
    assert np.abs(a - b).max() < 1e-12 and a[50] == 0 and a[110] > 0.45 and a[250] == pytest.approx(0.25)


READINGS = {
    "hum": (lambda x: abs(np.fft.rfft(x)[len(x) // 10]), 5), "crackle": (lambda x: (np.abs(np.diff(x, 2)) > 1.2).sum() + 1, 5), "dropouts": (lambda x: (x == 0).sum() + 1, 50),
    "tape_noise": (lambda x: np.std(x[:500]), 2), "clipping": (lambda x: (np.abs(x) == 0.5).sum() + 1, 10), "offset": (lambda x: abs(np.mean(x)) + 1e-3, 5), "rumble": (lambda x: np.abs(np.fft.rfft(x)[1:40]).max(), 5),
    "whistle": (lambda x: abs(np.fft.rfft(x)[round(0.35 * len(x))]), 5), "quantised": (lambda x: 1 / len(np.unique(x)), 10), "gated": (lambda x: (x == 0).sum() + 1, 50), "fluctuating": (lambda x: np.std([np.std(x[i : i + 50]) for i in range(1000, 3000, 50)]), 1.5),
    "inverted": (lambda x: 2 - np.sign(x[1600]), 2), "echo": (lambda x: np.std(x[1100:]), 1.4), "dull": (lambda x: 1 / np.abs(np.fft.rfft(x)[1200:]).max(), 5),
    "wobble": (lambda x: np.abs(np.fft.rfft(x[1000:])[140:148]).max(), 1.2),
}


@pytest.mark.parametrize("name", sorted([*defects.POINTWISE, *defects.WHOLE]))
def test_each_defect_moves_its_reading(spark, name):
    n = 4000
    r = np.random.default_rng(7)
    x = np.concatenate([0.004 * r.normal(size=1000), 0.55 * np.sin(2 * np.pi * 0.05 * np.arange(n - 1000) + 0.5) + 0.004 * r.normal(size=n - 1000)])
    reading, times = READINGS[name]
    df = frame(spark, x)
    y = ordered(defects.injected(df, name), "x")
    assert len(y) == n and reading(y) >= times * reading(x)
    assert np.array_equal(y, ordered(defects.injected(df.repartition(7), name), "x"))


def test_numbers_of_positions(spark):
    u = np.array([r[0] for r in spark.range(20_000).select(defects.uniform(F.col("id"), 5)).collect()])
    g = np.array([r[0] for r in spark.range(20_000).select(defects.gaussian(F.col("id"), 5)).collect()])
    assert 0 <= u.min() and u.max() <= 1 and abs(u.mean() - 0.5) < 0.02 and abs(np.corrcoef(u[1:], u[:-1])[0, 1]) < 0.05
    assert abs(g.mean()) < 0.05 and abs(g.std() - 1) < 0.05
    with pytest.raises(KeyError):
        defects.injected(spark.range(1), "none")


def test_scene_map_on_a_bar(spark, tmp_path):
    """A mean that is exactly the bar counts as reaching it, in whatever order its samples are added."""
    from sigloom.plans import spans

    xs = [31.29, 56.66, 40.73, 37.91, 58.41]  # adds up to less than 225 as doubles, whatever the order
    assert functools.reduce(lambda a, x: a + x, xs) / 5 < 45
    rows = [(i, u, f"2024-01-01 0{i}:00:00", x + 10 * (u == 4)) for u in range(5) for i, x in enumerate(xs[u:] + xs[:u])]
    spark.createDataFrame(rows, "event_id long, user_id long, at string, value double").selectExpr("event_id", "user_id", "CAST(at AS TIMESTAMP_NTZ) AS ts", "value").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.track: r for r in spans.QUERIES["temporal_scene_map"](spark, str(tmp_path)).collect()}
    assert [got[u].dialogue_ratio for u in range(4)] == [1.0] * 4 and not any(got[u].n_music for u in range(4))
