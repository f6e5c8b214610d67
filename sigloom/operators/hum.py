"""Hum lines followed by slow envelopes and taken off the samples, whatever the blocks.

A line is demodulated on the track's own grid of frames.  Its envelope has a bounded reach: a running median (what passes
through the line for a few frames doesn't count), a symmetric low-pass as wide as the line's band, a shrinkage by the noise
that the band holds, and a bound on how far it may rise above its own recent level.  So a block of samples with that much
context on both sides gives what the whole track would give.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.operators import layout, spectra
from sigloom.operators.filters import kaiser_low_pass

#: Widest band (Hz) whose envelope is steadied by a median first.
STEADIED = 10.0


def band(harmonic: int, base: float = 1.0) -> float:
    """Width (Hz) of the band a line is followed in."""
    return 2 * spectra.tolerance(harmonic, base)


def _odd(frames: float) -> int:
    return max(1, int(frames)) | 1


def reach(rate: float, hop: int, base: float, cap_s: float) -> int:
    """Frames on either side that the envelope of the narrowest band depends on."""
    per = rate / hop
    return _odd(per / base) // 2 + _odd(2 * per / base) // 2 + _odd(cap_s * per) // 2


def demodulated(x: np.ndarray, at: int, hz: np.ndarray, rate: float, window: int, hop: int) -> tuple[int, np.ndarray]:
    """(first frame, frames x lines): amplitude and phase of each line in every whole frame of samples that begin at ``at``."""
    first, last = -(-at // hop), (at + len(x) - window) // hop
    if last < first:
        return first, np.zeros((0, len(hz)), complex)
    w = spectra.hann(window)
    waves = np.exp(-2j * np.pi / rate * np.outer(np.arange(window), hz)) * (w * 2 / w.sum())[:, None]
    starts = np.arange(first, last + 1) * hop
    frames = np.lib.stride_tricks.sliding_window_view(x, window)[starts - at]
    return first, frames @ waves * np.exp(-2j * np.pi * (np.outer(starts, hz) % rate) / rate)


def envelope(z: np.ndarray, width: float, floor: float, per_second: float, cap_db: float, cap_s: float) -> np.ndarray:
    """The slow part of one line's frames: ``floor`` is the noise density (power a Hz) beside it."""
    median = lambda v, n: spectra.running_median(v, n, 0)
    if width < STEADIED:
        n = _odd(per_second / width)
        z = median(z.real, n) + 1j * median(z.imag, n)
    if width / per_second < 0.5:
        taps = kaiser_low_pass(_odd(2 * per_second / width), width / per_second)
        z = np.convolve(np.pad(z, len(taps) // 2, mode="edge"), taps, "valid")
    z = z * np.maximum(0.0, 1 - 4 * floor * width / np.maximum(np.abs(z) ** 2, 1e-30))  # noise of that density reads 4 * floor * width
    size = np.abs(z)
    most = median(size, _odd(cap_s * per_second)) * 10 ** (cap_db / 20)
    return z * np.minimum(1.0, most / np.maximum(size, 1e-30))


def hum_of(x: np.ndarray, at: int, lines: list[tuple[float, float, float]], rate: float, window: int, hop: int, cap_db: float, cap_s: float) -> np.ndarray:
    """The waveform of ``lines`` (Hz, band, floor) in samples that begin at ``at``."""
    first, base = demodulated(x, at, np.array([hz for hz, _, _ in lines]), rate, window, hop)
    out = np.zeros(len(x))
    if not len(base):
        return out
    ix, centres = np.arange(at, at + len(x)), (first + np.arange(len(base))) * hop + window / 2
    for (hz, width, floor), z in zip(lines, base.T, strict=True):
        e = envelope(z, width, floor, rate / hop, cap_db, cap_s)
        turn = 2 * np.pi * (ix * hz % rate) / rate
        out += np.interp(ix, centres, e.real) * np.cos(turn) - np.interp(ix, centres, e.imag) * np.sin(turn)
    return out


def lines_removed(
    samples: DataFrame, lines: DataFrame, rate: float, window: int = 4096, hop: int = 1024, base: float = 1.0, cap_db: float = 6.0, cap_s: float = 2.0,
    least_frames: int = 64, block: int = 1 << 20,
) -> DataFrame:
    """track, ix, y: samples (track, ix, x; positions without gaps) less the lines of their track.

    ``lines`` are those of ``spectra.hum_plan``: track, harmonic, line_hz, floor.  Tracks without lines, and those of fewer
    than ``least_frames`` frames, stay as they are; null samples are silence to the envelopes and stay null.
    """
    context = (reach(rate, hop, base, cap_s) + 1) * hop + window
    kind = dict(samples.dtypes)["track"]
    halo = layout.with_halo(samples.select("track", "ix", F.col("x").cast("double").alias("x")), context, context, block=block)
    sizes = samples.groupBy("track").agg((F.max("ix") + 1).alias("n")).where(F.col("n") >= window + (least_frames - 1) * hop)
    found = lines.groupBy("track").agg(F.sort_array(F.collect_list(F.struct("line_hz", "harmonic", "floor"))).alias("lines"))  # a series a track
    each = found.join(sizes, "track").select("track", "lines", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block))).alias("_blk"))

    def run(df: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("ix")
        x = df["x"].to_numpy(float)
        if len(df) and len(plan):
            wanted = [(s["line_hz"], band(s["harmonic"], base), s["floor"]) for s in plan["lines"].iloc[0]]
            x = x - hum_of(np.nan_to_num(x), int(df["ix"].iloc[0]), wanted, rate, window, hop, cap_db, cap_s)
        return pd.DataFrame({"track": df["track"], "ix": df["ix"], "y": x})[df["_own"].to_numpy(bool)]

    return halo.groupBy("track", "_blk").cogroup(each.groupBy("track", "_blk")).applyInPandas(run, f"track {kind}, ix long, y double")
