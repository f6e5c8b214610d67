"""Readings of spectra over tracks of any length: hum plans, channel skew by votes over spans, harmonic and percussive parts.

What is read per sample is summed by Spark; numpy sees frames, spans and block edges of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sigloom.operators import layout, transforms


#: Points a sample at which cross-correlations are looked at.
FINE = 8


def hann(n: int) -> np.ndarray:
    """Periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def framed(samples: DataFrame, window: int, hop: int) -> DataFrame:
    """track, f, x (array): whole frames of ``window`` samples (or of blocks of them), one every ``hop``."""
    return layout.slices(layout.blocked(samples, "x"), window, hop, "x")


def power(x: Column | str, window: int) -> Column:
    """Power spectrum of Hann-windowed frames (window / 2 + 1 bins)."""

    @pandas_udf("array<double>")
    def of(frames: pd.Series) -> pd.Series:
        w = hann(window)
        return pd.Series([np.abs(np.fft.rfft(f * w)) ** 2 for f in frames])

    return of(x)


def quiet_spectrum(samples: DataFrame, window: int, fraction: float = 0.2) -> DataFrame:
    """track, psd (array): mean power of the quietest ``fraction`` of a track's frames, half a window apart."""
    level = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    frames = layout.cut(framed(samples, window, window // 2).withColumn("level", level))
    q = layout.quantiles(frames.select("track", "level"), ["track"], "level", q=fraction)
    quiet = frames.join(q, "track").where("level <= q").select("track", F.posexplode(power("x", window)).alias("bin", "p"))
    bins = quiet.groupBy("track", "bin").agg(F.avg("p").alias("p"))
    return bins.groupBy("track").agg(F.sort_array(F.collect_list(F.struct("bin", "p"))).alias("s")).select("track", F.col("s.p").alias("psd"))  # a window's bins


def tolerance(harmonic: int, base: float = 1.0, slope: float = 0.5, most: float = 5.0) -> float:
    """How far (Hz) a line may sit off its multiple: half the band it is tracked in, which widens with its number."""
    return 0.5 * min(base + slope * (harmonic - 1), most)


def standing_out(psd: np.ndarray, width: float, f0: float, count: int, bars: tuple[float, float], core: int) -> dict[int, tuple[float, float]]:
    """Harmonics of ``f0`` that stand above the median of their neighbourhood (bins 3 to 30 off) by the bar for core or later
    ones, and are a line of their own within two bins: number to (excess in dB, that median).  ``width`` is a bin in Hz."""
    out = {}
    for h in range(1, count + 1):
        at = round(h * f0 / width)
        if at + 1 >= len(psd) - 1:
            break
        around = np.concatenate([psd[max(at - 30, 0) : max(at - 2, 0)], psd[at + 3 : at + 31]])
        peak, floor = psd[max(at - 1, 0) : at + 2].max() + 1e-20, np.median(around) + 1e-20
        near = max(at - 4, 0)
        local = near + int(np.argmax(psd[near : at + 5]))
        excess = 10 * math.log10(peak / floor)
        if abs(local - at) <= 2 and excess >= bars[h > core]:
            out[h] = (excess, float(floor))
    return out


def _peak(values: np.ndarray, i: int) -> float:
    """Where the parabola through the logarithms around place ``i`` peaks, as a shift of up to half a place."""
    if i in (0, len(values) - 1):
        return 0.0
    a, b, c = np.log(values[i - 1 : i + 2] + 1e-300)
    bend = a - 2 * b + c
    return 0.0 if bend >= 0 else float(np.clip(0.5 * (a - c) / bend, -0.5, 0.5))


def hum_plan(
    samples: DataFrame, rate: float, nominal: float = 50.0, count: int = 40, core: int = 8, window: int = 16384, fraction: float = 0.2, stretch: int = 1 << 20, hop: int = 1024,
    furthest: float = 0.5, bars: tuple[float, float] = (3.0, 6.0), margin: float = 100.0,
) -> DataFrame:
    """track, f0, harmonic, line_hz, excess_db, floor: the hum lines of each track to cancel; none for a track without hum.

    ``floor`` is the noise density (power a Hz) beside the line in the quiet frames.

    Core harmonics that stand out in the quiet frames (hum is there when the programme is not) vote for the fundamental: the
    one, within 1.5 times ``furthest`` of the nominal, at which their prominences in a long spectrum add up to most; a
    track that puts it further off than ``furthest`` has a chord, not hum.  Of the whole series at that fundamental those
    are kept that stand out and sit on their multiple, within a tolerance that grows with their number.

    The long spectrum is that of a track's first ``stretch`` samples near each multiple: Spark sums every harmonic's
    demodulated samples by ``hop`` on the absolute grid, and what is left is one small row a hop.
    """
    psd = quiet_spectrum(samples, window, fraction)
    turns = lambda h: F.pmod(F.col("ix") * F.lit(h * nominal / rate), F.lit(1.0)) * (2 * math.pi)
    top = min(count, math.ceil((rate / 2 - margin) / nominal) - 1)
    sums = [F.sum(F.col("x") * fn(turns(h))).alias(f"{k}{h}") for h in range(1, top + 1) for k, fn in (("c", F.cos), ("s", F.sin))]
    base = samples.where(F.col("ix") < stretch).groupBy("track", F.floor(F.col("ix") / hop).alias("j")).agg(*sums)
    # one flat array a track, hop after hop: nested rows become Python objects of many times their size
    row = F.struct("j", F.array(*[F.col(f"{k}{h}") for k in "cs" for h in range(1, top + 1)]).alias("v"))
    flat = base.groupBy("track").agg(F.sort_array(F.collect_list(row)).alias("s")).select("track", F.col("s.j").alias("j"), F.flatten("s.v").alias("v"))
    both = flat.join(psd, "track")  # stretch / hop rows a track
    kind = dict(samples.dtypes)["track"]

    def fit(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                out: list[tuple] = []
                for i in range(part.num_rows):
                    j, v, p = (part.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("j", "v", "psd"))
                    track = part.column("track")[i].as_py()
                    out += [(track, *line) for line in plan(p, j, v.reshape(len(j), 2, top))]
                names = ["track", "f0", "harmonic", "line_hz", "excess_db", "floor"]
                columns = list(zip(*out, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (part.schema.field("track").type, pa.float64(), pa.int32(), pa.float64(), pa.float64(), pa.float64()), strict=True)], names=names)

    def plan(psd: np.ndarray, j: np.ndarray, v: np.ndarray) -> list[tuple[float, int, float, float, float]]:
        width, density = rate / window, 2 / (rate * (hann(window) ** 2).sum())
        t, hops = j * hop / rate, len(j)
        b = (v[:, 0] - 1j * v[:, 1]) * np.hanning(hops + 2)[1:-1, None]
        found = [h for h in standing_out(psd, width, nominal, core, bars, core) if h <= top]
        if not found:
            return []
        # a step that the highest harmonic's main lobe can't slip through
        step = rate / (hops * hop) / max(found) / 4
        grid = np.arange(-1.5 * furthest, 1.5 * furthest + step, step)
        total = np.zeros(len(grid))
        for h in found:
            near = np.abs(np.exp(-2j * np.pi * h * np.outer(grid, t)) @ b[:, h - 1]) ** 2
            total += np.log10(1 + near / (np.median(near) + 1e-300))  # on a logarithm, so that no line carries the vote alone
        i = int(np.argmax(total))
        f0 = nominal + grid[i] + step * _peak(np.exp(total), i)
        if abs(f0 - nominal) > furthest:
            return []
        lines = []
        for h, (excess, floor) in standing_out(psd, width, f0, top, bars, core).items():
            reach = tolerance(h) + furthest
            offs = np.arange(-reach, reach, rate / (hops * hop) / 4)
            near = np.abs(np.exp(-2j * np.pi * np.outer(h * (f0 - nominal) + offs, t)) @ b[:, h - 1]) ** 2
            i = int(np.argmax(near))
            off = offs[i] + (offs[1] - offs[0]) * _peak(near, i)
            if abs(off) <= tolerance(h):
                lines.append((float(f0), h, float(h * f0 + off), float(excess), floor * density))
        return lines

    return both.mapInArrow(fit, f"track {kind}, f0 double, harmonic int, line_hz double, excess_db double, floor double")


def span_peak(left: np.ndarray, right: np.ndarray, rate: float, reach: int, band: tuple[float, float] = (150.0, 7000.0), least_bins: int = 64) -> tuple[float, float] | None:
    """(lag of ``right`` behind ``left`` in samples, signed phase coherence) of one span; None with too few live bins.

    The cross-spectrum keeps only its phase, in bins of the band where both channels carry power within 30 dB of their
    medians; transformed back on a grid of ``FINE`` points a sample it peaks at the lag, which a parabola places between them.
    """
    n = 1 << (2 * len(left) - 1).bit_length()
    w = np.hanning(len(left))
    sl, sr = np.fft.rfft(left * w, n), np.fft.rfft(right * w, n)
    f = np.fft.rfftfreq(n, 1 / rate)
    inside = (f >= band[0]) & (f <= min(band[1], 0.45 * rate))
    live = inside.copy()
    if inside.any():
        for s in (sl, sr):
            p = np.abs(s) ** 2
            live &= p > np.median(p[inside]) * 1e-3
    if live.sum() < least_bins:
        return None
    cross = sr * np.conj(sl)
    back = np.fft.irfft(np.where(live, cross / (np.abs(cross) + 1e-30), 0), n * FINE) * n * FINE / (2 * live.sum())
    wide = reach * FINE
    near = np.concatenate([back[-wide:], back[: wide + 1]])
    i = int(np.argmax(np.abs(near)))
    shift = 0.0
    if 0 < i < len(near) - 1:
        a, b, c = np.abs(near[i - 1 : i + 2])
        bend = a - 2 * b + c
        shift = float(np.clip(0.5 * (a - c) / bend, -0.5, 0.5)) if bend < 0 else 0.0
    return (i - wide + shift) / FINE, float(near[i])


def voted(lags: Sequence[float], coherences: Sequence[float], tried: int, least: float = 0.3, apart: float = 0.5) -> tuple[float | None, int, float | None, str]:
    """(lag, spans that agree, their median coherence, reason) of the spans read.

    The lag that most spans of enough coherence agree on (of equals the smaller shift) wins if more than half of these do, and
    two at least where more than one was tried; else there is none, and the reason says why.
    """
    counted = [(lag, abs(c)) for lag, c in zip(lags, coherences, strict=True) if abs(c) >= least]
    if not counted:
        return None, 0, None, "weak coherence" if len(lags) else "no programme"
    at = np.array([lag for lag, _ in counted])
    support = (np.abs(at[:, None] - at) <= apart).sum(axis=1)
    ties = at[support == support.max()]
    centre = ties[np.argmin(np.abs(ties))]
    agree = [(lag, c) for lag, c in counted if abs(lag - centre) <= apart]
    if len(agree) < max(2 if tried > 1 else 1, len(counted) // 2 + 1):
        return None, len(agree), None, "spans disagree"
    return float(np.median([lag for lag, _ in agree])), len(agree), float(np.median([c for _, c in agree])), ""


def channel_skew(pairs: DataFrame, rate: float, most: int, span: int | None = None, spans: int = 7, least_samples: int = 2048, band: tuple[float, float] = (150.0, 7000.0), least_bins: int = 64) -> DataFrame:
    """track, lag, spans, agree, coherence, reason, delay_ms of pairs (track, ix, left, right): how far right runs behind left.

    The loudest spans that don't overlap (1.5 s each, on a grid of half spans) each give a lag, and the lags vote.
    delay_ms is 0 where there is none, where it is under half a sample, or beyond ``most``.  A track that is too short, or
    has a null or non-finite sample, is refused; a silent one has no programme.
    """
    span = span or round(1.5 * rate)
    hop = max(1, span // 2)
    finite = lambda c: F.coalesce(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.lit(False))
    held = layout.kept_blocks(pairs, "left", "right")
    rows = layout.unblocked(held, "left", "right")
    tracks = layout.cut(rows.groupBy("track").agg(F.count("*").alias("n"), F.bool_and(finite("left") & finite("right")).alias("sound")))
    good = held.join(tracks.where(F.col("sound") & (F.col("n") >= least_samples)).select("track"), "track")
    energies = layout.unblocked(good, "left", "right").groupBy("track", F.floor(F.col("ix") / hop).alias("hop"))
    blocks = layout.cut(energies.agg(F.sum(F.col("left") ** 2 + F.col("right") ** 2).alias("e"), F.count("*").alias("m")).where(F.col("m") == hop).drop("m"))
    starts = layout.lagged(blocks, ["track"], "hop", after=("e", -1)).where(F.col("after").isNotNull())
    loud = starts.select("track", F.col("hop").alias("fix"), (-(F.col("e") + F.col("after"))).alias("level")).where(F.col("level") < 0)
    picks = transforms.quietest_apart(loud, spans, 2).select("track", "pick", (F.col("fix") * hop).alias("start"), ((F.col("fix") + 2) * hop).alias("stop"))

    # a block gives each span the samples it has of it
    reach = F.explode(F.sequence(F.floor(F.col("start") / layout.BLOCK), F.floor((F.col("stop") - 1) / layout.BLOCK)))
    wanted = picks.select("track", reach.alias("blk"), F.struct("pick", "start", "stop").alias("s")).groupBy("track", "blk").agg(F.collect_list("s").alias("spans"))
    low = lambda s: F.greatest(s["start"] - F.col("first"), F.lit(0))
    part = lambda c, s: F.slice(c, (low(s) + 1).cast("int"), (F.least(s["stop"] - F.col("first"), F.size(c)) - low(s)).cast("int")).alias(c)
    given = F.explode(F.transform("spans", lambda s: F.struct(s["pick"].alias("pick"), (F.col("first") + low(s)).alias("at"), part("left", s), part("right", s))))
    parts = held.join(wanted, ["track", "blk"]).select("track", given.alias("s")).groupBy("track", F.col("s.pick").alias("pick")).agg(F.sort_array(F.collect_list(F.struct("s.at", "s.left", "s.right"))).alias("s"))
    whole = parts.select("track", F.flatten(F.col("s.left")).alias("left"), F.flatten(F.col("s.right")).alias("right"))

    def read(r: dict) -> dict[str, np.ndarray]:
        return {"got": span_peak(r["left"], r["right"], rate, min(most + 2, len(r["left"]) - 1), band, least_bins) or ()}

    peaks = transforms.mapped(whole, ["track"], "left", read, "got").select("track", F.get("got", F.lit(0)).alias("lag"), F.get("got", F.lit(1)).alias("coherence"))
    peaks = peaks.groupBy("track").agg(F.count("*").alias("tried"), F.collect_list(F.when(F.col("lag").isNotNull(), F.struct("lag", "coherence"))).alias("p"))  # a few spans a track

    @pandas_udf("lag double, agree int, coherence double, reason string")
    def vote(tried: pd.Series, p: pd.Series) -> pd.DataFrame:
        out = [voted([s["lag"] for s in (ps if ps is not None else [])], [s["coherence"] for s in (ps if ps is not None else [])], 0 if n is None or n != n else int(n)) for n, ps in zip(tried, p, strict=True)]
        return pd.DataFrame(out, columns=["lag", "agree", "coherence", "reason"])

    r = tracks.join(peaks, "track", "left").withColumn("v", vote("tried", "p"))
    why = F.when(F.col("n") < least_samples, "too short").when(~F.col("sound"), "non-finite samples").otherwise(F.col("v.reason"))
    lag = F.col("v.lag")
    delay = F.when(lag.isNotNull() & (F.abs(lag) >= 0.5) & (F.abs(lag) <= most), F.round(lag / rate * 1000, 3)).otherwise(0.0)
    return r.select("track", lag.alias("lag"), F.coalesce(F.size("p"), F.lit(0)).alias("spans"), F.col("v.agree").alias("agree"), F.round("v.coherence", 4).alias("coherence"), why.alias("reason"), delay.alias("delay_ms"))


def running_median(m: np.ndarray, k: int, axis: int) -> np.ndarray:
    """Median of ``k`` neighbours along an axis, the edge values repeated beyond the ends."""
    pad = [(k // 2, k // 2) if a == axis else (0, 0) for a in range(m.ndim)]
    return np.median(np.lib.stride_tricks.sliding_window_view(np.pad(m, pad, mode="edge"), k, axis=axis), axis=-1)


def parted(x: np.ndarray, at: int, window: int, hop: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(harmonic, percussive) parts of samples that begin at position ``at``: frames are centred on multiples of ``hop``."""
    centres = np.arange(-(-at // hop), (at + len(x) - 1) // hop + 2) * hop - at
    half, w = window // 2, hann(window)
    padded = np.concatenate([np.zeros(half), x, np.zeros(half + hop)])
    spec = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(padded, window)[centres] * w, axis=1)
    size = np.abs(spec)
    steady, struck = running_median(size, k, 0) ** 2, running_median(size, k, 1) ** 2
    mask = steady / (steady + struck + 1e-20)
    frames = np.fft.irfft(spec * mask, window, axis=1) * w
    out, norm = np.zeros(len(padded)), np.zeros(len(padded))
    for c, f in zip(centres, frames, strict=True):
        out[c : c + window] += f
        norm[c : c + window] += w * w
    harmonic = (out / np.maximum(norm, 1e-12))[half : half + len(x)]
    return harmonic, x - harmonic


def harmonic_percussive(samples: DataFrame, window: int = 2048, hop: int = 512, k: int = 17, block: int = 1 << 16) -> DataFrame:
    """track, ix, harmonic, percussive: parts that add up to the sample, by medians of the spectrum along time and frequency.

    A tone is steady along time and a click along frequency; each cell is shared by the squares of the two medians.  The
    context of a block covers the frames and their median, so blocks don't show.
    """

    def kernel(x: np.ndarray, at: int) -> dict[str, np.ndarray]:
        h, p = parted(x, at, window, hop, k)
        return {"harmonic": h, "percussive": p}

    return transforms.by_block(samples, kernel, "harmonic double, percussive double", (k // 2 + 2) * hop + 2 * window, block)


def onsets(percussive: DataFrame, rate: float, window: int = 2048, hop: int = 512, refractory: float = 0.05) -> DataFrame:
    """track, f, strength: frames of percussive samples (track, ix, x) where the spectrum rises, summed over bins, to a peak above the track's
    mean plus deviation; of peaks closer than ``refractory`` seconds the first counts."""
    frames = framed(percussive, window, hop).select("track", "f", power("x", window).alias("p"))
    log = F.transform("p", lambda v: F.log10(v + 1e-12))
    steps = layout.lagged(layout.cut(frames.select("track", "f", log.alias("l"))), ["track"], "f", before=("l", 1))
    rise = F.aggregate(F.zip_with("l", "before", lambda a, b: F.greatest(a - b, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
    s = layout.cut(steps.select("track", "f", F.coalesce(rise, F.lit(0.0)).alias("strength")))
    bar = s.groupBy("track").agg((F.avg("strength") + F.stddev_pop("strength")).alias("bar"))
    peaks = layout.lagged(s, ["track"], "f", prev=("strength", 1), next=("strength", -1)).join(bar, "track")
    peaks = peaks.where((F.col("strength") > F.col("bar")) & (F.col("strength") > F.col("prev")) & (F.col("strength") >= F.col("next")))
    return spaced(peaks.select("track", "f", "strength"), max(1, math.ceil(refractory * rate / hop)))


def spaced(peaks: DataFrame, apart: int) -> DataFrame:
    """Peaks (track, f, strength) taken in order, each at least ``apart`` after the one taken before.

    A peak that far from the peak before it is always taken, so only chains of closer ones are folded in order.
    """
    k = layout.numbered(peaks, ["track"], ["f"], F.floor(F.col("f") / layout.BLOCK), "ix")
    gaps = layout.lagged(k, ["track"], prev=("f", 1)).withColumn("begins", F.coalesce(F.col("f") - F.col("prev") >= apart, F.lit(True)))
    chains = layout.running_sum(gaps, ["track"], F.col("begins").cast("long"), "chain")
    none = F.expr("CAST(array() AS ARRAY<STRUCT<f: BIGINT, strength: DOUBLE>>)")
    rows = chains.groupBy("track", "chain").agg(F.sort_array(F.collect_list(F.struct("f", "strength"))).alias("s"))
    taken = F.aggregate("s", none, lambda acc, v: F.when((F.size(acc) == 0) | (v["f"] - F.element_at(acc, -1)["f"] >= apart), F.concat(acc, F.array(v))).otherwise(acc))
    return rows.select("track", F.explode(taken).alias("t")).select("track", "t.f", "t.strength")
