"""Windows in pauses against a greedy pick one by one, hiss in pauses against planted noise."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from sigloom.operators import pauses

RATE, FRAME = 16000.0, 320


def greedy(levels, reach):
    taken = []
    for i in sorted(levels, key=lambda i: (levels[i], i)):
        if all(abs(i - t) >= reach for t in taken):
            taken.append(i)
    return taken


@pytest.mark.parametrize("reach,block", [(1, 16), (7, 16), (20, 16), (5, 8192)])
def test_apart_is_the_greedy_pick_whatever_the_blocks(spark, reach, block):
    r = np.random.default_rng(reach)
    at = sorted(r.choice(400, 250, replace=False).tolist())
    tracks = {
        "random": dict(zip(at, r.normal(size=250).tolist())),
        "ties": {i: float(v) for i, v in zip(at, r.integers(0, 3, 250))},
        "falling": {i: -float(i) for i in range(70)},  # each waits for the next one
        "rising": {i: float(i) for i in range(70)},
        "one": {5: 1.0},
    }
    rows = [(k, i, v) for k, t in tracks.items() for i, v in t.items()] + [("one", 6, None), ("one", 7, float("nan")), (None, 3, 1.0)]
    got = {}
    for x in pauses.apart(spark.createDataFrame(rows, "track string, ix long, level double").repartition(3), reach, block).collect():
        got.setdefault(x.track, set()).add(x.ix)
    assert got == {**{k: set(greedy(t, reach)) for k, t in tracks.items()}, None: {3}}


def test_spread_takes_even_steps_of_level(spark):
    rows = [("a", i, float(i)) for i in range(10)] + [("few", 7, 1.0), ("few", 3, 1.0)] + [("one", 4, 0.0)]
    picks = spark.createDataFrame(rows, "track string, ix long, level double")
    of = lambda n: sorted((r.track, r.ix) for r in pauses.spread(picks, n).collect())
    assert of(4) == [("a", 0), ("a", 3), ("a", 6), ("a", 9), ("few", 3), ("few", 7), ("one", 4)]
    assert of(1) == [("a", 0), ("few", 3), ("one", 4)]
    assert [i for t, i in of(3) if t == "a"] == [0, 4, 9]
    assert pauses.spread(picks.limit(0), 3).count() == 0


def test_windows_stand_in_the_pauses(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=24_000)
    quiet = [(2000, 3000), (9000, 9800), (15_000, 17_000)]
    for k, (a, b) in enumerate(quiet):
        x[a:b] *= 0.01 * (k + 1)
    df = spark.createDataFrame(pd.DataFrame({"track": 1, "ix": np.arange(len(x)), "x": x})).repartition(4)
    got = pauses.pause_windows(df, 100, 4, 3, 0.1).orderBy("start").collect()
    assert len(got) == 3 and all(any(a <= w.start and w.stop <= b for a, b in quiet) for w in got)
    assert all(w.stop - w.start == 400 and w.level == pytest.approx(np.sqrt(np.mean(x[w.start : w.stop] ** 2))) for w in got)
    assert pauses.pause_windows(df.where("ix < 350"), 100, 4, 3).count() == 0 and pauses.pause_windows(df.limit(0), 100).count() == 0


def talk(r, seconds=12):
    """Bursts of tones and a pause in turn, and where the bursts are."""
    n = int(RATE * seconds)
    t = np.arange(n) / RATE
    on = (np.floor(t / 1.5) % 2 == 0).astype(float)
    return 0.3 * on * sum(np.sin(2 * np.pi * f * t + p) for f, p in ((220, 0), (900, 1), (2700, 2), (6100, 3))), n


def pair(spark, **tracks):
    frames = [pd.DataFrame({"track": k, "ix": np.arange(len(s)), "src": s, "out": o}) for k, (s, o) in tracks.items()]
    return spark.createDataFrame(pd.concat(frames)).repartition(4)


def test_hiss_in_pauses(spark):
    r = np.random.default_rng(5)
    voice, n = talk(r)
    hiss, low = 0.003 * r.normal(size=n), 0.003 * r.normal(size=n)
    low = np.convolve(low, np.hanning(161) / np.hanning(161).sum(), "same")  # nothing above a few hundred Hz
    df = pair(spark, same=(voice + hiss, voice + hiss), half=(voice + hiss, voice + hiss / 2), dull=(voice + hiss, voice + low), dead=(voice + hiss, voice), louder=(voice + hiss, 4 * (voice + hiss)), short=(voice[:4000], voice[:4000]))
    got = {r.track: r for r in pauses.hiss_in_pauses(df, RATE, FRAME, segment=None, quiet=0.3).collect()}
    a, same = got["half"], got["same"]
    assert same.pause_frames > 100 and same.reason is None and same.src_margin_db == same.out_margin_db and same.room_delta_db == 0
    assert a.src_margin_db - a.out_margin_db == pytest.approx(6.02, abs=0.05) and a.out_sone < a.src_sone and a.room_delta_db == pytest.approx(-6.02, abs=0.1)
    assert a.out_room_onset_db - a.src_room_onset_db == pytest.approx(6.02, abs=0.05)
    assert got["louder"].out_margin_db == pytest.approx(same.out_margin_db, abs=1e-6)  # each side against its own loud frames
    room = [b for lo, hi, b in pauses.bands_of(RATE, FRAME) if 100 <= math.sqrt(lo * hi) < 1500]
    level = lambda x: np.mean([sum(np.abs(np.fft.rfft(f * np.hanning(FRAME)))[sorted(sum(room, []))] ** 2) for f in x.reshape(-1, FRAME)])
    assert got["dull"].out_margin_db < 0 < same.out_margin_db and got["dull"].room_delta_db == pytest.approx(10 * math.log10(level(low) / level(hiss)), abs=1.5)
    assert got["dead"].out_margin_db <= -50 and got["dead"].out_sone == 0 and got["dead"].room_delta_db < -60
    assert got["short"].reason == "too few pauses" and got["short"].src_margin_db is None


def test_floor_of_white_noise_is_its_level(spark):
    """The margin of white noise by its density, without frames."""
    r = np.random.default_rng(7)
    voice, n = talk(r, 18)
    got = pauses.hiss_in_pauses(pair(spark, x=(voice + 0.002 * r.normal(size=n), voice)), RATE, FRAME, segment=None, quiet=0.3).first()
    on = voice[: int(1.4 * RATE)]
    loud = 10 * math.log10(np.mean(on**2))
    bands = pauses.bands_of(RATE, FRAME)
    rel = [10 * math.log10(0.002**2 * len(b) * 2 / FRAME) - loud + 10 * math.log10(pauses.hiss_weight(math.sqrt(lo * hi))) for lo, hi, b in bands]
    smooth = [10 * math.log10(np.mean([10 ** (rel[min(max(i + d, 0), len(rel) - 1)] / 10) for d in range(-2, 3)])) for i in range(len(rel))]
    want = max(75 + s - (pauses.hearing.quiet_db(math.sqrt(lo * hi)) - 3) for s, (lo, hi, _) in zip(smooth, bands) if math.sqrt(lo * hi) >= 2000)
    assert got.src_margin_db == pytest.approx(want, abs=0.6)


def test_soft_programme_in_pauses_is_not_hiss(spark):
    r = np.random.default_rng(6)
    voice, n = talk(r, 24)
    hiss = 0.003 * r.normal(size=n)
    t = np.arange(n) / RATE
    soft = 0.02 * r.normal(size=n) * ((t % 3 > 1.5) & (t % 3 < 2.0))  # a third of every pause
    df = pair(spark, x=(voice + hiss + soft, voice + hiss), y=(voice + hiss, voice + hiss))
    keys = dict(quiet=0.45, margin_db=40.0, shortest=10)
    with_, without = ({q.track: q for q in pauses.hiss_in_pauses(df, RATE, FRAME, segment=s, **keys).collect()} for s in (500, None))
    assert with_["y"].src_margin_db == pytest.approx(without["y"].src_margin_db, abs=0.4)
    assert abs(with_["x"].src_margin_db - with_["y"].src_margin_db) <= abs(without["x"].src_margin_db - without["y"].src_margin_db) + 0.2
    assert with_["x"].src_margin_db == pytest.approx(with_["y"].src_margin_db, abs=1.5)


def test_steady_levels(spark):
    r = np.random.default_rng(3)
    bands = pauses.bands_of(RATE, FRAME)
    shape = np.array([max(len(b) / pauses.CORRELATED, 0.5) for *_, b in bands])
    e = r.gamma(shape, 1 / shape, size=(3000, len(bands)))  # mean 1
    e[:, 3] *= np.repeat(10 ** r.normal(0, 1, 60), 50)  # comes and goes
    rows = [(1, i, row.tolist()) for i, row in enumerate(e)]
    got = {x.band: x.level for x in pauses.steady_levels(spark.createDataFrame(rows, "track int, f long, src array<double>"), RATE, FRAME, 500).collect()}
    assert 3 not in got and len(got) >= len(bands) - 4
    assert all(v == pytest.approx(1.0, rel=0.25) for v in got.values())


def test_no_frames(spark):
    df = pair(spark, x=(np.zeros(100), np.zeros(100)))
    r = pauses.hiss_in_pauses(df, RATE, FRAME).collect()
    assert [(x.track, x.pause_frames, x.reason) for x in r] == [("x", 0, "too few pauses")]
    assert pauses.hiss_in_pauses(df.limit(0), RATE, FRAME).count() == 0
    z = pauses.hiss_in_pauses(pair(spark, z=(np.zeros(16_000), np.zeros(16_000))).where(F.col("ix") >= 0), RATE, FRAME, segment=None).first()
    assert z.pause_frames == 50 and z.reason == "programme in every pause"  # silence holds no floor
