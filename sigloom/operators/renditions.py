"""A source against what was made of it: bands over the body, what is left of the hiss, and readings of a whole file.

Samples come as (track, ix, src, out), positions without gaps.  Frames are read once, into a few numbers each; what follows
are quantiles, sums and windows of bounded reach over those.  ``spectrum`` gives the power spectrum of an array of samples;
the default is a Hann-windowed one in numpy, for frames of any length.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.operators import layout, spectra

Spectrum = Callable[[Column, int], Column]

#: Bands (Hz) read over the body, and lines of screens that no band counts, with the half width left out around them.
HIGH_BANDS, BODY = {"4k8k": (4000.0, 8000.0), "8k16k": (8000.0, 16000.0)}, (300.0, 4000.0)
SCREEN_LINES, SKIRT = (15625.0, 15734.0), 250.0
#: Hiss is read in bands of one ERB between these, the presence bands end below PRESENCE, the stationary ones begin at STEADY.
HISS, PRESENCE, STEADY, TOP_MARGIN = (3000.0, 16000.0), 4800.0, 8000.0, 100.0
#: Bands that tell programme from pauses, and the band in which a rendition is matched to its source.
ACTIVE_BANDS, MATCHED = ((100.0, 500.0), (500.0, 2000.0), (2000.0, 5000.0), (5000.0, 12000.0)), (100.0, 4000.0)
#: Step of 16 bits, and how far over its dither a band must stand to be read.
STEP, DITHER_DB, TINY = 1 / 32768, 10.0, 1e-20


def framed(pairs: DataFrame, frame: int) -> DataFrame:
    """track, f, src, out (arrays), level (root mean square of the source): whole frames, one after the other."""
    level = F.sqrt(F.aggregate("src", F.lit(0.0), lambda a, x: a + x * x) / frame)
    return layout.slices(layout.blocked(pairs, "src", "out"), frame, frame, "src", "out").withColumn("level", level)


def bins_within(lo: float, hi: float, rate: float, frame: int, without: tuple[float, ...] = ()) -> list[int]:
    """Bins from ``lo`` up to below ``hi``, less those near the lines ``without``."""
    hz = [k * rate / frame for k in range(frame // 2 + 1)]
    return [k for k, f in enumerate(hz) if lo <= f < hi and all(abs(f - line) > SKIRT for line in without)]


def energy(p: Column, bins: list[int]) -> Column:
    """Sum of the bins of a power spectrum."""
    edges = [k for k in bins if k - 1 not in bins]
    stops = [k + 1 for k in bins if k + 1 not in bins]
    add = lambda a, x: a + x
    return sum((F.aggregate(F.slice(p, a + 1, b - a), F.lit(0.0), add) for a, b in zip(edges, stops, strict=True)), F.lit(0.0))


def decibel(power: Column) -> Column:
    return 10 * F.log10(power + TINY)


def high_ratios(pairs: DataFrame, rate: float, frame: int = 4096, loud: float = 0.7, bands: dict[str, tuple[float, float]] = HIGH_BANDS, bandwidth: DataFrame | None = None, spectrum: Spectrum = spectra.power) -> DataFrame:
    """track, band, src_db, out_db: power of each band over that of the body, in the frames where the source is loud.

    Pauses don't count: a denoiser that empties them takes nothing off the voice.  With ``bandwidth`` (track, bandwidth_hz)
    a band that begins at or above its track's programme is null, since all it holds is hiss; a track it doesn't name is read
    in full.
    """
    bins = {name: bins_within(lo, hi, rate, frame, SCREEN_LINES) for name, (lo, hi) in bands.items()}
    bins["body"] = bins_within(*BODY, rate, frame)
    p = framed(pairs, frame).select("track", "f", "level", spectrum(F.col("src"), frame).alias("src"), spectrum(F.col("out"), frame).alias("out"))
    read = layout.cut(p.select("track", "level", *[energy(F.col(s), b).alias(f"{s}_{n}") for n, b in bins.items() for s in ("src", "out")]))
    q = layout.quantiles(read, ["track"], "level", q=loud)
    sums = read.join(q, "track").where("level >= q").groupBy("track").agg(*[F.sum(f"{s}_{n}").alias(f"{s}_{n}") for n in bins for s in ("src", "out")], F.count("*").alias("n"))
    ratio = lambda s, n: 10 * F.log10((F.col(f"{s}_{n}") / F.col("n") + TINY) / (F.col(f"{s}_body") / F.col("n") + TINY))
    rows = F.array(*[F.struct(F.lit(n).alias("band"), F.lit(float(bands[n][0])).alias("lo"), ratio("src", n).alias("src_db"), ratio("out", n).alias("out_db")) for n in bands])
    long_ = sums.select("track", F.explode(rows).alias("r")).select("track", "r.*")
    if bandwidth is None:
        return long_.drop("lo")
    held = F.coalesce(F.col("lo") < F.col("bandwidth_hz"), F.lit(True))
    return long_.join(bandwidth.select("track", "bandwidth_hz"), "track", "left").select("track", "band", *[F.when(held, F.col(c)).alias(c) for c in ("src_db", "out_db")])


def erb_edges(lo: float, hi: float) -> list[float]:
    """Edges (Hz) of as many equal bands on the ERB scale as are at least one ERB wide."""
    number = [21.4 * math.log10(4.37e-3 * f + 1) for f in (lo, hi)]
    n = max(1, math.floor(number[1] - number[0]))
    return [(10 ** (float(z) / 21.4) - 1) / 4.37e-3 for z in np.linspace(*number, n + 1)]


def hiss_bands(rate: float, frame: int) -> list[tuple[int, float, float, list[int]]]:
    """(band, lo, hi, bins) of the hiss bands that hold a bin."""
    edges = erb_edges(HISS[0], min(HISS[1], rate / 2 - TOP_MARGIN))
    all_ = [(i, lo, hi, bins_within(lo, hi, rate, frame)) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))]
    return [b for b in all_ if b[3]]


def readable_db(bins: int, frame: int) -> float:
    """Level a band of so many bins must exceed: dither of 16 bits, and a margin."""
    return 10 * math.log10(STEP**2 / 4 * float((spectra.hann(frame) ** 2).sum()) * bins + TINY) + DITHER_DB


def _around(keys: list[str], before: int, after: int) -> tuple[Window, Window]:
    w = layout.in_block(keys, "f")
    return w, w.rowsBetween(-before, after)


def programme(bands: DataFrame, smooth: int = 3, reach: int = 4, margin_db: float = 6.0, floor: float = 0.1) -> DataFrame:
    """track, f, speech: frames in which a band of ``bands`` (track, f, vad: array) stands ``margin_db`` over its own low level.

    Powers are averaged over ``smooth`` frames (an odd number; beyond an end its value goes on), and what is found reaches
    ``reach`` frames further on both sides.
    """
    half = smooth // 2
    long_ = bands.select("track", "f", F.posexplode("vad").alias("band", "e"))
    w, _ = _around(["track", "band"], 0, 0)
    total, back, ahead = F.col("e"), F.col("e"), F.col("e")
    for k in range(1, half + 1):
        back, ahead = F.coalesce(F.lag("e", k).over(w), back), F.coalesce(F.lead("e", k).over(w), ahead)
        total = total + back + ahead
    levels = layout.cut(layout.own(layout.with_halo(long_, half, half, "f").withColumn("l", decibel(total / (2 * half + 1)))).select("track", "f", "band", "l"))
    q = layout.quantiles(levels, ["track", "band"], "l", q=floor)
    active = levels.join(q, ["track", "band"]).groupBy("track", "f").agg(F.bool_or(F.col("l") > F.col("q") + margin_db).alias("a"))
    _, near = _around(["track"], reach, reach)
    return layout.own(layout.with_halo(active, reach, reach, "f").withColumn("speech", F.bool_or("a").over(near))).select("track", "f", "speech")


def hiss_under_programme(
    pairs: DataFrame, rate: float, frame: int, smooth: int = 3, reach: int = 4, half: int = 38, least: int = 10, loud: float = 0.7, least_match: float = 0.5, margin_db: float = 6.0,
    spectrum: Spectrum = spectra.power,
) -> DataFrame:
    """track, floor_gap_db, median_delta_db, presence_delta_db, gain_db, correlation, share, reason: the hiss that a rendition
    keeps under its programme, against its source.

    The floor of a band is a minimum statistic: around every programme frame the tenth percentile of the band's energy over the
    programme frames within ``half`` (where they are half of all there), and of these the median.  The rendition is
    brought to the source's level by the gain that fits it best on the loud frames.  floor_gap_db tells how steady the
    source's upper bands are (median less tenth percentile); median_delta_db is the median over readable bands, and
    presence_delta_db the change in energy of the bands that end below ``PRESENCE``.  Without a reading all are null and
    ``reason`` says why; defaults are for frames of 20 ms.
    """
    hiss = hiss_bands(rate, frame)
    f = framed(pairs, frame)
    both = F.zip_with("src", "out", lambda a, b: a + b)
    p = f.select("track", "f", "level", spectrum(F.col("src"), frame).alias("s"), spectrum(F.col("out"), frame).alias("o"), spectrum(both, frame).alias("b"))
    match = bins_within(*MATCHED, rate, frame)
    arrays = [F.array(*[energy(F.col(c), b[3]) for b in hiss]).alias(n) for c, n in (("s", "src"), ("o", "out"))]
    vad = F.array(*[energy(F.col("s"), b) for b in (bins_within(*r, rate, frame) for r in ACTIVE_BANDS) if b])
    read = layout.cut(p.select("track", "f", "level", *arrays, vad.alias("vad"), *[energy(F.col(c), match).alias(f"m{c}") for c in "sob"]))

    q = layout.quantiles(read, ["track"], "level", q=loud)
    fit = read.join(q, "track").where("level >= q").groupBy("track").agg(F.sum((F.col("mb") - F.col("ms") - F.col("mo")) / 2).alias("cross"), F.sum("mo").alias("po"), F.sum("ms").alias("ps"))  # cross from the power of the sum
    power = F.col("po") * F.col("ps")
    fit = fit.select("track", F.when(F.col("po") > TINY, F.col("cross") / F.col("po")).otherwise(0.0).alias("gain"), F.when(power > TINY, F.col("cross") / F.sqrt(power)).otherwise(0.0).alias("correlation"))

    speech = layout.cut(programme(read.select("track", "f", "vad"), smooth, reach, margin_db))
    long_ = read.select("track", "f", F.posexplode(F.arrays_zip("src", "out")).alias("band", "e")).select("track", "f", "band", "e.src", "e.out")
    marked = layout.with_halo(long_.join(speech, ["track", "f"]), half, half, "f")
    _, near = _around(["track", "band"], half, half)
    low = lambda c: F.percentile(F.when(F.col("speech"), F.col(c)), 0.1).over(near)
    windows = marked.withColumns({"ls": low("src"), "lo": low("out"), "n": F.count_if("speech").over(near), "m": F.count("*").over(near)})
    windows = layout.cut(layout.own(windows).where(F.col("speech") & (2 * F.col("n") >= F.col("m"))).select("track", "band", "ls", "lo"))
    enough = windows.groupBy("track", "band").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("track", "band")
    floors = layout.quantiles(windows, ["track", "band"], "ls", src=0.5).join(layout.quantiles(windows, ["track", "band"], "lo", out=0.5), ["track", "band"]).join(enough, ["track", "band"])

    known = p.sparkSession.createDataFrame([(i, lo, hi, readable_db(len(b), frame)) for i, (_, lo, hi, b) in enumerate(hiss)], "band int, lo double, hi double, bar double")
    per = floors.join(F.broadcast(known), "band").join(fit, "track").withColumns({"src_db": decibel(F.col("src")), "out_db": decibel(F.col("out") * F.col("gain") ** 2)})
    valid, low_ = F.col("src_db") > F.col("bar"), F.col("hi") <= PRESENCE
    sums = [F.sum(F.when(valid & low_, F.pow(F.lit(10.0), F.col(c) / 10))).alias(n) for c, n in (("src_db", "es"), ("out_db", "eo"))]
    deltas = per.groupBy("track").agg(F.percentile(F.when(valid, F.col("out_db") - F.col("src_db")), 0.5).alias("median_delta_db"), *sums, F.count("*").alias("bands"))
    deltas = deltas.withColumn("presence_delta_db", decibel(F.col("eo")) - decibel(F.col("es")))

    spread = layout.quantiles(long_.select("track", "band", decibel(F.col("src")).alias("l")), ["track", "band"], "l", low=0.1, mid=0.5).join(F.broadcast(known), "band")
    gaps = spread.where((F.col("lo") >= STEADY) & (F.col("low") > F.col("bar"))).groupBy("track").agg(F.percentile(F.col("mid") - F.col("low"), 0.5).alias("floor_gap_db"))
    share = speech.groupBy("track").agg(F.avg(F.col("speech").cast("double")).alias("share"), F.count("*").alias("frames"))

    tracks = pairs.select("track").distinct()
    all_ = tracks.join(share, "track", "left").join(fit, "track", "left").join(deltas, "track", "left").join(gaps, "track", "left")
    reason = F.when(F.coalesce("frames", F.lit(0)) < least, "too short to read").when((F.col("correlation") < least_match) | (F.col("gain") <= 0), "the rendition does not follow its source").when(F.col("bands").isNull(), "too little programme to read the floor under")
    numbers = {"floor_gap_db": F.col("floor_gap_db"), "median_delta_db": F.col("median_delta_db"), "presence_delta_db": F.col("presence_delta_db"), "gain_db": 20 * F.log10("gain"), "correlation": F.col("correlation"), "share": F.col("share")}
    return all_.withColumn("reason", reason).select("track", *[F.when(F.col("reason").isNull(), c).alias(n) for n, c in numbers.items()], "reason")


def _peak_ratio(psd: Column, hz: float, rate: float, window: int) -> Column:
    """Power of the bin nearest to ``hz`` over the median of up to 20 bins on each side, its neighbours left out."""
    last = window // 2
    if hz >= rate / 2:
        return F.lit(1.0)
    at = round(hz * window / rate)
    width = min(20, at - 1, last - at - 1)
    if width <= 0:
        return psd[at] / 1e-12
    around = [*range(at - width, at - 1), *range(at + 2, at + 2 + width)]
    ordered = F.array_sort(F.array(*[psd[k] for k in around if k <= last]))
    n = len([k for k in around if k <= last])
    middle = (ordered[(n - 1) // 2] + ordered[n // 2]) / 2
    return psd[at] / (middle + 1e-12)


def file_readings(
    samples: DataFrame, rate: float, window: int = 8192, screen_hz: float = 15625.0, mains_hz: float = 50.0, rumble_hz: float = 100.0, floor_frame: int | None = None, spectrum: Spectrum = spectra.power,
) -> DataFrame:
    """track, peak_db, rms_db, floor_db, snr_db, whistle_ratio, hum_ratio, rumble_pct, balance_db of (track, ix, left, right).

    The floor is the tenth percentile of the levels of overlapping frames (200 ms, every 100 ms), or the level of a track
    that is no longer than one; the ratios are read in a spectrum averaged over windows half a window apart, each less its mean.
    Tracks shorter than one window have no ratios.
    """
    frame = floor_frame or int(rate) // 5
    hop = max(1, frame // 2)
    held = layout.kept_blocks(samples, "left", "right")
    x = layout.unblocked(held, "left", "right").withColumn("x", (F.col("left") + F.col("right")) / 2)
    level = lambda c, n=1: F.sqrt(F.sum(c) / (n * F.count("*")))
    squares = {c: F.col(c) * F.col(c) for c in ("left", "right")}
    whole = x.groupBy("track").agg(
        F.max(F.greatest(F.abs("left"), F.abs("right"))).alias("peak"), level(squares["left"] + squares["right"], 2).alias("rms"), level(squares["left"]).alias("l"), level(squares["right"]).alias("r"), F.count("*").alias("n"),
    )
    hops = x.groupBy("track", F.floor(F.col("ix") / hop).alias("f")).agg(F.sum(F.col("x") * F.col("x")).alias("e"), F.count("*").alias("m")).where(F.col("m") == hop)
    pairs = layout.lagged(layout.cut(hops), ["track"], "f", after=("e", -1)).where(F.col("after").isNotNull())
    ends = pairs.join(whole.select("track", "n"), "track").where(F.col("f") * hop < F.col("n") - 2 * hop)  # a frame that ends with the track is left out
    floor = layout.quantiles(ends.select("track", F.sqrt((F.col("e") + F.col("after")) / (2 * hop)).alias("v")), ["track"], "v", floor=0.1)

    mono = held.select("track", "blk", "first", F.zip_with("left", "right", lambda a, b: (a + b) / 2).alias("x"))
    frames = spectra.framed(mono, window, window // 2)
    mean = F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / window
    level_ = frames.select("track", "x", mean.alias("mean")).select("track", F.transform("x", lambda v: v - F.col("mean")).alias("x"))
    bins = level_.select("track", F.posexplode(spectrum(F.col("x"), window)).alias("bin", "p")).groupBy("track", "bin").agg(F.avg("p").alias("p"))
    scale = 1 / (rate * float((spectra.hann(window) ** 2).sum()))  # one-sided density: inner bins count twice
    density = F.when((F.col("bin") == 0) | (F.col("bin") == window // 2), F.col("p")).otherwise(2 * F.col("p")) * scale
    psd = bins.groupBy("track").agg(F.array_sort(F.collect_list(F.struct("bin", density.alias("p")))).alias("s")).select("track", F.col("s.p").alias("psd"))  # a window's bins
    below = round(rumble_hz * window / rate)
    add = lambda a, v: a + v
    read = psd.select("track", _peak_ratio(F.col("psd"), screen_hz, rate, window).alias("whistle_ratio"), _peak_ratio(F.col("psd"), mains_hz, rate, window).alias("hum_ratio"),
        (100 * F.aggregate(F.slice("psd", 1, below), F.lit(0.0), add) / (F.aggregate("psd", F.lit(0.0), add) + 1e-12)).alias("rumble_pct"))
    db = lambda c: 20 * F.log10(c + 1e-9)
    r = whole.join(floor, "track", "left").join(read, "track", "left").withColumn("floor", db(F.coalesce(F.when(F.col("n") > 2 * hop, F.col("floor")), F.col("rms"))))
    return r.select("track", db(F.col("peak")).alias("peak_db"), db(F.col("rms")).alias("rms_db"), F.col("floor").alias("floor_db"), (db(F.col("rms")) - F.col("floor")).alias("snr_db"),
        "whistle_ratio", "hum_ratio", "rumble_pct", F.abs(db(F.col("l")) - db(F.col("r"))).alias("balance_db"))


def improvements(before: DataFrame, after: DataFrame) -> DataFrame:
    """track and what the readings of ``after`` improve over those of ``before`` (both of ``file_readings``)."""
    b, a = before.alias("b"), after.alias("a")
    lower = {"noise_reduction_db": "floor_db", "rumble_reduction_pct": "rumble_pct", "balance_gain_db": "balance_db"}
    quieter = {"whistle_attenuation": "whistle_ratio", "hum_attenuation": "hum_ratio"}
    return b.join(a, "track").select("track", (F.col("a.snr_db") - F.col("b.snr_db")).alias("snr_gain_db"), *[(F.col(f"b.{c}") - F.col(f"a.{c}")).alias(n) for n, c in lower.items()],
        *[(F.col(f"b.{c}") / F.greatest(F.col(f"a.{c}"), F.lit(0.05))).alias(n) for n, c in quieter.items()])
