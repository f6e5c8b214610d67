"""Filters over blocks against the same filters over whole tracks."""

import math

import numpy as np
import pytest
from sigloom.operators import filters


def frame(spark, x, track=1):
    return spark.createDataFrame([(track, i, float(v)) for i, v in enumerate(x)], "track long, ix long, x double").repartition(5)


def ordered(df, column="y"):
    return np.array([r[column] for r in sorted(df.collect(), key=lambda r: r.ix)])


def sample_by_sample(sections, x):
    y = np.asarray(x, float)
    for b0, b1, b2, a1, a2 in sections:
        z1 = z2 = 0.0
        out = []
        for v in y.tolist():
            w = b0 * v + z1
            z1, z2 = b1 * v - a1 * w + z2, b2 * v - a2 * w
            out.append(w)
        y = np.array(out)
    return y


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(4).normal(size=3001)


@pytest.mark.parametrize("sections", [[filters.high_pass_section(0.0002)], filters.butterworth("low", 4, 0.01), filters.k_weighting(48000), [*filters.butterworth("high", 4, 0.02), filters.high_shelf_section(0.1, -6.0)]])
def test_recursive_filter_at_any_cutoff_and_cut(spark, noise, sections):
    want = sample_by_sample(sections, noise)
    assert np.abs(filters.Cascade(sections).run(noise, np.zeros(2 * len(sections))) - want).max() < 1e-9
    for block, group in ((8192, 4096), (333, 3), (64, 2), (1000, 100)):
        assert np.abs(ordered(filters.recursive(frame(spark, noise), sections, block, group)) - want).max() < 1e-8


def test_tracks_do_not_mix(spark, noise):
    df = frame(spark, noise[:500], 1).union(frame(spark, noise[:700] * 2, -2))
    got = {t: ordered(filters.recursive(df, filters.k_weighting(8000), 100).where(f"track = {t}")) for t in (1, -2)}
    assert np.abs(got[1] - sample_by_sample(filters.k_weighting(8000), noise[:500])).max() < 1e-9
    assert np.abs(got[-2] - sample_by_sample(filters.k_weighting(8000), noise[:700] * 2)).max() < 1e-9
    assert filters.recursive(df.where("false"), filters.k_weighting(8000)).collect() == []


def test_butterworth_halves_the_power_at_its_cutoff():
    x = np.sin(2 * np.pi * 0.05 * np.arange(4000))
    for kind in ("low", "high"):
        y = sample_by_sample(filters.butterworth(kind, 4, 0.05), x)[2000:]
        assert np.mean(y**2) / np.mean(x[2000:] ** 2) == pytest.approx(0.5, rel=0.01)


def test_loudness_of_a_full_scale_tone(spark):
    rate = 8000
    x = np.sin(2 * np.pi * 997 * np.arange(5 * rate) / rate)
    r = filters.loudness(frame(spark, x), rate).head()
    assert r.loudness == pytest.approx(-3.01, abs=0.35)  # the shelf sits a little lower at this rate
    assert r.lra == pytest.approx(0.0, abs=0.01) and r.blocks == 47


def by_hand(x, rate):
    y = sample_by_sample(filters.k_weighting(rate), x)
    level = lambda p: -0.691 + 10 * math.log10(p) if p > 0 else -math.inf

    def gated(seg):
        cell = rate // 10
        p = [np.mean(seg[i * cell : (i + 4) * cell] ** 2) for i in range(len(seg) // cell - 3)]
        p = [v for v in p if level(v) > -70]
        p = [v for v in p if level(v) > level(np.mean(p)) - 10] if p else []
        return (level(np.mean(p)), len(p)) if p else (None, 0)

    short = [gated(y[s : s + 3 * rate])[0] for s in range(0, len(y) - 3 * rate + 1, rate)]
    short = np.array([v for v in short if v is not None and v > -70])
    kept = short[short > 10 * np.log10(np.mean(10 ** (short / 10))) - 20] if len(short) else short
    return (*gated(y), float(np.percentile(kept, 95) - np.percentile(kept, 10)) if len(kept) else 0.0)


def test_loudness_and_range_of_a_swelling_noise(spark):
    rate, r = 1600 * 2, np.random.default_rng(9)
    x = r.normal(size=9 * rate) * np.repeat([0.001, 0.3, 0.2, 0.05, 0.0, 0.4, 0.02, 0.3, 0.1], rate)
    want = by_hand(x, rate)
    got = filters.loudness(frame(spark, x), rate).head()
    assert got.loudness == pytest.approx(want[0], abs=1e-9) and got.blocks == want[1] and got.lra == pytest.approx(want[2], abs=1e-9)
    assert want[2] > 1
    quiet = filters.loudness(frame(spark, np.zeros(rate)), rate).head()
    assert (quiet.loudness, quiet.lra, quiet.blocks) == (None, 0.0, 0)


def test_bands_add_up_and_blocks_do_not_show(spark, noise):
    df = frame(spark, noise)
    whole = sorted(filters.split_bands(df, 0.05, 101).collect(), key=lambda r: r.ix)
    cut = sorted(filters.split_bands(df, 0.05, 101, block=300).collect(), key=lambda r: r.ix)
    assert max(abs(r.low + r.high - v) for r, v in zip(whole, noise, strict=True)) < 1e-9
    assert max(abs(a.low - b.low) for a, b in zip(whole, cut, strict=True)) < 1e-12
    assert np.abs(ordered(filters.recombined(df, df, 0.05, 101, 300), "x") - noise).max() < 1e-9
    with pytest.raises(ValueError):
        filters.split_bands(df, 0.5)


@pytest.mark.parametrize("up, down", [(3, 2), (2, 3), (1, 4), (160, 147), (4, 2)])
def test_resampling_keeps_a_tone(spark, up, down):
    f = 0.02
    n = 2400
    df = frame(spark, np.sin(2 * np.pi * f * np.arange(n)))
    y = ordered(filters.resampled(df, up, down))
    assert len(y) == math.ceil(n * up / down)
    t = np.arange(len(y)) * down / up
    inside = (t > 200) & (t < n - 200)
    assert np.abs(y - np.sin(2 * np.pi * f * t))[inside].max() < 1e-4
    assert np.abs(ordered(filters.resampled(df, up, down, block=171)) - y).max() < 1e-12


def test_resampling_removes_what_the_lower_rate_cannot_hold(spark):
    y = ordered(filters.resampled(frame(spark, np.sin(2 * np.pi * 0.2 * np.arange(2400))), 1, 4))
    assert np.abs(y[60:-60]).max() < 1e-4


def test_lone_blocks_pass_no_state_on(spark, monkeypatch):
    """Tracks of one block, whole or not, and one of two blocks and a rest against the same filter over one array."""
    rnd = np.random.default_rng(5)
    tracks = {1: rnd.normal(size=20), 2: rnd.normal(size=64), 3: rnd.normal(size=150)}
    df = spark.createDataFrame([(t, i, float(v)) for t, x in tracks.items() for i, v in enumerate(x)], "track long, ix long, x double")
    sections = filters.butterworth("high", 4, 0.1)
    got = {(r.track, r.ix): r.y for r in filters.recursive(df, sections, block=64, group=2).collect()}
    f = filters.Cascade(sections)
    want = {(t, i): float(v) for t, x in tracks.items() for i, v in enumerate(f.run(x, np.zeros(f.size)))}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    plan = filters.recursive(df.where("track = 1"), sections, block=64)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan
