"""Hum taken off, high bands, hiss under the programme and file readings against whole-track numpy."""

import numpy as np
import pandas as pd
import pytest
from sigloom.operators import hum, renditions, spectra

RATE, HOP, WINDOW = 4000, 100, 400


def frame(spark, **columns):
    n = len(next(iter(columns.values())))
    return spark.createDataFrame(pd.DataFrame({"track": 1, "ix": np.arange(n), **columns})).repartition(4)


def ordered(df, c="y"):
    return np.array([r[c] for r in df.select("ix", c).orderBy("ix").collect()], dtype=float)


def lines(spark, *rows):
    return spark.createDataFrame([(1, h, hz, f) for h, hz, f in rows], "track long, harmonic int, line_hz double, floor double")


def test_hum_is_followed_and_taken_off(spark):
    n = 60_000
    t, r = np.arange(n) / RATE, np.random.default_rng(3)
    swell = 1 + 0.3 * np.sin(2 * np.pi * 0.1 * t)
    humming = swell * (0.1 * np.sin(2 * np.pi * 49.98 * t + 1) + 0.05 * np.cos(2 * np.pi * 149.94 * t))
    programme = 0.3 * np.sin(2 * np.pi * 440 * t) + 0.01 * r.normal(size=n)
    plan = lines(spark, (1, 49.98, 1e-8), (3, 149.94, 1e-8))
    keys = dict(window=WINDOW, hop=HOP)
    df = frame(spark, x=humming + programme)
    y = ordered(hum.lines_removed(df, plan, RATE, **keys))
    inside = slice(4000, -4000)
    assert np.sqrt(np.mean((y - programme)[inside] ** 2)) < 0.1 * np.sqrt(np.mean(humming[inside] ** 2))
    whole = hum.hum_of(humming + programme, 0, [(49.98, 1.0, 1e-8), (149.94, 2.0, 1e-8)], RATE, WINDOW, HOP, 6.0, 2.0)
    assert np.abs(y - (humming + programme - whole)).max() < 1e-9
    cut = ordered(hum.lines_removed(df, plan, RATE, **keys, block=7000))
    assert np.abs(cut - y).max() < 1e-9
    assert np.abs(ordered(hum.lines_removed(df, lines(spark, (1, 49.98, 1.0)), RATE, **keys)) - (humming + programme)).max() == 0  # less than the noise beside it


def test_hum_bounds(spark):
    per = RATE / HOP
    z = np.full(800, 0.01 + 0j)
    z[400:] = 1.0  # a swell that stays is followed, but not at once
    e = np.abs(hum.envelope(z, 20.0, 0.0, per, 6.0, 2.0))
    assert e[:350] == pytest.approx(0.01, rel=1e-6) and e[500:] == pytest.approx(1.0, rel=1e-6)
    z[400:], z[400:430] = 0.01, 1.0
    assert np.abs(hum.envelope(z, 20.0, 0.0, per, 6.0, 2.0)).max() <= 0.01 * 10 ** 0.3 + 1e-12  # a passing note is held to the bound
    z[400:], z[400:415] = 0.01, 1.0
    assert np.abs(hum.envelope(z, 1.0, 0.0, per, 6.0, 2.0)) == pytest.approx(0.01, rel=1e-6)  # one shorter than half the median's span leaves no mark


def test_hum_leaves_what_it_cannot_follow(spark):
    x = np.sin(np.arange(3000) / 7)
    df = frame(spark, x=x)
    assert (ordered(hum.lines_removed(df, lines(spark, (1, 50.0, 0.0)), RATE, window=WINDOW, hop=HOP)) == x).all()  # too short
    assert (ordered(hum.lines_removed(df, lines(spark).limit(0), RATE, window=WINDOW, hop=HOP)) == x).all()
    assert hum.lines_removed(df.limit(0), lines(spark, (1, 50.0, 0.0)), RATE).count() == 0
    odd = spark.createDataFrame([(1, i, None if i == 5 else float(v)) for i, v in enumerate(x)], "track long, ix long, x double")
    y = {r.ix: r.y for r in hum.lines_removed(odd, lines(spark, (1, 50.0, 0.0)), RATE, window=WINDOW, hop=10, least_frames=4).collect()}
    assert len(y) == 3000 and (y[5] is None or np.isnan(y[5])) and not np.isnan(y[6])


def test_planned_lines_are_taken_off(spark):
    n = 80_000
    t, r = np.arange(n) / RATE, np.random.default_rng(2)
    noise = 0.001 * r.normal(size=n)
    humming = sum(0.02 / h * np.sin(2 * np.pi * h * 49.98 * t + h) for h in range(1, 5))
    df = frame(spark, x=humming + noise)
    plan = spectra.hum_plan(df, rate=RATE, window=2048, count=12, stretch=n, hop=100)
    floors = [r.floor for r in plan.collect()]
    assert len(floors) == 4 and floors == pytest.approx([2 * 1e-6 / RATE] * 4, rel=0.8)  # the density of the noise (its quiet frames, by median)
    y = ordered(hum.lines_removed(df, plan, RATE, window=WINDOW, hop=HOP))
    assert np.std((y - noise)[4000:-4000]) < 0.05 * np.std(humming)


def spectra_of(x, n):
    f = x[: len(x) // n * n].reshape(-1, n)
    return np.abs(np.fft.rfft(f * spectra.hann(n), axis=1)) ** 2, np.sqrt((f**2).mean(axis=1))


def test_high_ratios(spark):
    r, n, rate = np.random.default_rng(1), 256, 44100.0
    loud = np.repeat(r.uniform(0.01, 1, 100), n)
    x = r.normal(size=100 * n) * loud
    y = np.convolve(x, [0.25, 0.5, 0.25], "same") * (loud > 0.3)
    (ps, level), (po, _) = spectra_of(x, n), spectra_of(y, n)
    on, hz = level >= np.percentile(level, 70), np.arange(n // 2 + 1) * rate / n
    df = frame(spark, src=x, out=y)
    got = {g.band: g for g in renditions.high_ratios(df, rate, n).collect()}
    for name, (lo, hi) in renditions.HIGH_BANDS.items():
        b = (hz >= lo) & (hz < hi) & (np.abs(hz - 15625) > 250) & (np.abs(hz - 15734) > 250)
        body = (hz >= 300) & (hz < 4000)
        want = [10 * np.log10(p[on][:, b].sum() / p[on][:, body].sum()) for p in (ps, po)]
        assert (got[name].src_db, got[name].out_db) == (pytest.approx(want[0]), pytest.approx(want[1]))
    narrow = spark.createDataFrame([(1, 5000.0)], "track long, bandwidth_hz double")
    held = {g.band: g.src_db for g in renditions.high_ratios(df, rate, n, bandwidth=narrow).collect()}
    assert held["8k16k"] is None and held["4k8k"] == pytest.approx(got["4k8k"].src_db)


def brute_hiss(x, y, rate, n, half=38, reach=4):
    (ps, level), (po, _), (pb, _) = spectra_of(x, n), spectra_of(y, n), spectra_of(x + y, n)
    hz = np.arange(n // 2 + 1) * rate / n
    pick = lambda p, lo, hi: p[:, (hz >= lo) & (hz < hi)].sum(axis=1)
    db = lambda p: 10 * np.log10(p + 1e-20)
    on = level >= np.percentile(level, 70)
    m = [pick(p, 100, 4000)[on].sum() for p in (ps, po, pb)]
    gain, r = (m[2] - m[0] - m[1]) / 2 / m[1], (m[2] - m[0] - m[1]) / 2 / np.sqrt(m[0] * m[1])
    active = np.zeros(len(ps), bool)
    for lo, hi in renditions.ACTIVE_BANDS:
        e = np.pad(pick(ps, lo, hi), 1, mode="edge")
        l = db((e[:-2] + e[1:-1] + e[2:]) / 3)  # noqa: E741
        active |= l > np.percentile(l, 10) + 6
    speech = np.array([active[max(0, i - reach) : i + reach + 1].any() for i in range(len(active))])
    deltas, energy, gaps = [], [0.0, 0.0], []
    for _, lo, hi, bins in renditions.hiss_bands(rate, n):
        floors = []
        for i in np.flatnonzero(speech):
            w = slice(max(0, i - half), i + half + 1)
            if speech[w].mean() >= 0.5:
                floors.append([np.percentile(p[w][speech[w]][:, bins].sum(axis=1), 10) for p in (ps, po)])
        s, o = np.median(floors, axis=0)
        if db(s) > renditions.readable_db(len(bins), n):
            deltas.append(db(o * gain**2) - db(s))
            if hi <= renditions.PRESENCE:
                energy = [energy[0] + s, energy[1] + o * gain**2]
        e = db(ps[:, bins].sum(axis=1))
        if lo >= renditions.STEADY and np.percentile(e, 10) > renditions.readable_db(len(bins), n):
            gaps.append(np.median(e) - np.percentile(e, 10))
    return np.median(gaps), np.median(deltas), db(energy[1]) - db(energy[0]), 20 * np.log10(gain), r, speech.mean()


def test_hiss_against_brute_force_and_over_block_borders(spark):
    r, n, rate = np.random.default_rng(5), 32, 32000.0
    frames = 9000  # more than one block of frames
    t = np.arange(frames * n) / rate
    voice = np.sin(2 * np.pi * 1000 * t) * np.repeat(r.random(frames // 60) > 0.4, 60 * n)
    hiss = 0.02 * r.normal(size=frames * n)
    x, y = voice + hiss, 0.5 * (voice + 0.3 * hiss)
    got = renditions.hiss_under_programme(frame(spark, src=x, out=y), rate, n).collect()[0]
    want = brute_hiss(x, y, rate, n)
    assert got.reason is None
    assert (got.floor_gap_db, got.median_delta_db, got.presence_delta_db, got.gain_db, got.correlation, got.share) == tuple(pytest.approx(w, rel=1e-6, abs=1e-6) for w in want)
    assert got.median_delta_db == pytest.approx(20 * np.log10(0.3), abs=0.5) and got.gain_db == pytest.approx(20 * np.log10(2), abs=0.1)


def test_hiss_reasons(spark):
    r, n = np.random.default_rng(7), 32
    x = r.normal(size=200 * n)
    rows = {1: (x, r.normal(size=200 * n)), 2: (x[: 4 * n], x[: 4 * n]), 3: (x[:5], x[:5]), 4: (np.zeros(50 * n), np.zeros(50 * n))}
    df = pd.concat([pd.DataFrame({"track": k, "ix": np.arange(len(a)), "src": a, "out": b}) for k, (a, b) in rows.items()])
    got = {g.track: g for g in renditions.hiss_under_programme(spark.createDataFrame(df), 32000.0, n).collect()}
    assert [got[k].reason for k in (1, 2, 3, 4)] == ["the rendition does not follow its source", "too short to read", "too short to read", "the rendition does not follow its source"]
    assert all(got[k].median_delta_db is None for k in got)


def test_file_readings(spark):
    r, rate, n = np.random.default_rng(9), 8000.0, 30_000
    t = np.arange(n) / rate
    left = 0.1 * r.normal(size=n) * (1 + np.sin(t)) + 0.2 * np.sin(2 * np.pi * 50 * t)
    right = 0.5 * left + 0.01 * r.normal(size=n)
    df = frame(spark, left=left, right=right)
    g = renditions.file_readings(df, rate, window=2048, screen_hz=3000.0).collect()[0]
    mono = (left + right) / 2
    both = np.concatenate([left, right])
    assert g.peak_db == pytest.approx(20 * np.log10(np.abs(both).max() + 1e-9)) and g.rms_db == pytest.approx(20 * np.log10(np.sqrt((both**2).mean()) + 1e-9))
    levels = [np.sqrt((mono[i : i + 1600] ** 2).mean()) for i in range(0, n - 1600, 800)]
    assert g.floor_db == pytest.approx(20 * np.log10(np.percentile(levels, 10) + 1e-9)) and g.snr_db == pytest.approx(g.rms_db - g.floor_db)
    frames = np.lib.stride_tricks.sliding_window_view(mono, 2048)[::1024]
    w = spectra.hann(2048)
    psd = (np.abs(np.fft.rfft((frames - frames.mean(axis=1, keepdims=True)) * w, axis=1)) ** 2).mean(axis=0) / rate / (w**2).sum()
    psd[1:-1] *= 2
    assert g.rumble_pct == pytest.approx(100 * psd[: round(100 * 2048 / rate)].sum() / psd.sum())
    at = round(3000 * 2048 / rate)
    assert g.whistle_ratio == pytest.approx(psd[at] / np.median(np.concatenate([psd[at - 20 : at - 1], psd[at + 2 : at + 22]])), rel=1e-4)
    assert g.hum_ratio > 50 and g.balance_db == pytest.approx(20 * np.log10(2), abs=0.2)
    after = renditions.file_readings(df.selectExpr("track", "ix", "left / 2 AS left", "right / 2 AS right"), rate, window=2048, screen_hz=3000.0)
    i = renditions.improvements(renditions.file_readings(df, rate, window=2048, screen_hz=3000.0), after).collect()[0]
    assert i.noise_reduction_db == pytest.approx(20 * np.log10(2), abs=1e-4) and i.snr_gain_db == pytest.approx(0, abs=1e-4)
    short = renditions.file_readings(frame(spark, left=left[:100], right=right[:100]), rate, window=2048).collect()[0]
    assert short.floor_db == pytest.approx(short.rms_db) and short.hum_ratio is None
