"""Filters over tracks of any length.  Tracks are cut into blocks; results don't depend on the cuts.

A recursive filter is linear in its state, so a block takes the state s before it to A^n s + e, where e is the state it
ends in when it starts from rest.  Blocks find their e on their own; the states between blocks then follow by composing
these maps, first over groups of blocks, then inside each group; and a last pass filters every block from its true state.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.operators import layout, transforms

#: A second-order section: b0, b1, b2, a1, a2 (a0 is 1).
Section = tuple[float, float, float, float, float]
#: Samples that one matrix product filters; blocks of a group in the scan over blocks.
STRIDE, GROUP = 64, 4096


def low_pass_section(cutoff: float, q: float = math.sqrt(0.5)) -> Section:
    """Second-order low-pass; ``cutoff`` in cycles per sample."""
    w = 2 * math.pi * cutoff
    alpha, cos = math.sin(w) / (2 * q), math.cos(w)
    a0 = 1 + alpha
    return ((1 - cos) / 2 / a0, (1 - cos) / a0, (1 - cos) / 2 / a0, -2 * cos / a0, (1 - alpha) / a0)


def high_pass_section(cutoff: float, q: float = math.sqrt(0.5)) -> Section:
    w = 2 * math.pi * cutoff
    alpha, cos = math.sin(w) / (2 * q), math.cos(w)
    a0 = 1 + alpha
    return ((1 + cos) / 2 / a0, -(1 + cos) / a0, (1 + cos) / 2 / a0, -2 * cos / a0, (1 - alpha) / a0)


def high_shelf_section(cutoff: float, gain_db: float, q: float = math.sqrt(0.5)) -> Section:
    w, a = 2 * math.pi * cutoff, 10 ** (gain_db / 40)
    alpha, cos, root = math.sin(w) / (2 * q), math.cos(w), 2 * math.sqrt(a)
    a0 = (a + 1) - (a - 1) * cos + root * alpha
    b = (a * ((a + 1) + (a - 1) * cos + root * alpha), -2 * a * ((a - 1) + (a + 1) * cos), a * ((a + 1) + (a - 1) * cos - root * alpha))
    return (*(v / a0 for v in b), 2 * ((a - 1) - (a + 1) * cos) / a0, ((a + 1) - (a - 1) * cos - root * alpha) / a0)


def butterworth(kind: str, order: int, cutoff: float) -> list[Section]:
    """Sections of an even-order Butterworth ``low`` or ``high`` pass."""
    make = {"low": low_pass_section, "high": high_pass_section}[kind]
    return [make(cutoff, 1 / (2 * math.cos(math.pi * (2 * k + 1) / (2 * order)))) for k in range(order // 2)]


def k_weighting(rate: float) -> list[Section]:
    """The pre-filter of loudness: a shelf of 4 dB from 1500 Hz and a high-pass at 38 Hz."""
    return [high_shelf_section(1500.0 / rate, 4.0), high_pass_section(38.0 / rate, 0.5)]


def state_space(sections: Sequence[Section]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """A, B, C, D of the cascade (transposed direct form, two states a section)."""
    n = 2 * len(sections)
    a, b, c, d = np.zeros((n, n)), np.zeros(n), np.zeros(n), 1.0
    for k, (b0, b1, b2, a1, a2) in enumerate(sections):
        u_state, u_in = c.copy(), d  # what enters this section, as a function of earlier states and the input
        i = 2 * k
        y_state = b0 * u_state
        y_state[i] += 1
        y_in = b0 * u_in
        a[i] += b1 * u_state - a1 * y_state
        a[i, i + 1] += 1
        a[i + 1] += b2 * u_state - a2 * y_state
        b[i], b[i + 1] = b1 * u_in - a1 * y_in, b2 * u_in - a2 * y_in
        c, d = y_state, y_in
    return a, b, c, d


class Cascade:
    """Runs a cascade of sections over arrays, ``STRIDE`` samples to a matrix product."""

    def __init__(self, sections: Sequence[Section]):
        self.a, b, c, d = state_space(sections)
        self.size = len(b)
        powers = [np.eye(self.size)]
        for _ in range(STRIDE):
            powers.append(self.a @ powers[-1])
        self.step = powers[STRIDE]
        self.seen = np.array([c @ p for p in powers[:STRIDE]])  # a state's part of the samples after it
        self.kept = np.array([powers[STRIDE - 1 - k] @ b for k in range(STRIDE)])  # a sample's part of the state after the stride
        impulse = np.array([d, *(c @ powers[k] @ b for k in range(STRIDE - 1))])
        lag = np.subtract.outer(np.arange(STRIDE), np.arange(STRIDE))
        self.inner = np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0)

    def states(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``x``, a whole number of strides, as rows, and the state before each and after the last."""
        rows = x.reshape(-1, STRIDE)
        out = np.empty((len(rows) + 1, self.size))
        out[0] = state
        for j, e in enumerate(rows @ self.kept):
            out[j + 1] = self.step @ out[j] + e
        return rows, out

    def end(self, x: np.ndarray) -> np.ndarray:
        """The state after ``x`` from rest."""
        padded = np.concatenate([np.zeros(-len(x) % STRIDE), x])  # at rest, silence before changes nothing
        return self.states(padded, np.zeros(self.size))[1][-1]

    def run(self, x: np.ndarray, state: np.ndarray) -> np.ndarray:
        whole = len(x) // STRIDE * STRIDE
        rows, states = self.states(x[:whole], state)
        y = rows @ self.inner.T + states[:-1] @ self.seen.T
        rest = x[whole:]
        tail = self.inner[: len(rest), : len(rest)] @ rest + self.seen[: len(rest)] @ states[-1]
        return np.concatenate([y.ravel(), tail])

    def after(self, n: int, state: np.ndarray) -> np.ndarray:
        """What is left of a state after ``n`` samples."""
        return np.linalg.matrix_power(self.a, n) @ state


def recursive(samples: DataFrame, sections: Sequence[Section], block: int = layout.BLOCK, group: int = GROUP) -> DataFrame:
    """track, ix, y: the samples (track, ix, x, or blocks of them; positions without gaps, nulls as 0) through a cascade of sections, at rest
    before a track's first sample.  Exact for any coefficients and any cut into blocks, up to rounding."""
    kind = dict(samples.dtypes)["track"]
    held = layout.kept_blocks(samples, "x", block=block).select("track", "blk", F.floor(F.col("blk") / group).alias("big"), "first", "x")
    f = Cascade(sections)

    def along(df: pd.DataFrame, state: np.ndarray, f: Cascade) -> tuple[list[np.ndarray], np.ndarray]:
        """The state before each row, in order, and after the last."""
        before = []
        for n, e in zip(df["n"], df["end"], strict=True):
            before.append(state)
            state = f.after(int(n), state) + e
        return before, state

    def whole(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("blk")
        return pd.DataFrame({"track": df["track"].iloc[:1].to_numpy(), "big": df["big"].iloc[:1].to_numpy(), "n": [int(df["n"].sum())], "end": [along(df, np.zeros(f.size), f)[1]]})

    def over_groups(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("big")
        return pd.DataFrame({"track": df["track"], "big": df["big"], "start": along(df, np.zeros(f.size), f)[0]})

    def inside(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("blk")
        before, last = along(df, np.asarray(df["start"].iloc[0]), f)
        return pd.DataFrame({"track": df["track"], "blk": df["blk"] + 1, "state": [*before[1:], last]})

    # only whole blocks can have another one after them: a track of one block needs no state of any other
    whole_blocks = held.where(F.size("x") == block).select("track", "blk", "big", F.size("x").cast("long").alias("n"), "x")
    parts = layout.cut(transforms.mapped(whole_blocks, ["track", "blk", "big", "n"], "x", lambda r: {"end": f.end(r["x"])}, "end", fill=0.0))
    first = held.where("blk = 0").select("track", "first", "x", F.array_repeat(F.lit(0.0), 2 * len(sections)).alias("state"))
    if not parts.isEmpty():
        groups = parts.groupBy("track", "big").applyInPandas(whole, f"track {kind}, big long, n long, end array<double>")
        starts = groups.groupBy("track").applyInPandas(over_groups, f"track {kind}, big long, start array<double>")  # a row for 33 million samples
        states = parts.join(starts, ["track", "big"]).groupBy("track", "big").applyInPandas(inside, f"track {kind}, blk long, state array<double>")
        first = first.unionByName(held.where("blk > 0").join(states, ["track", "blk"]).select("track", "first", "x", "state"))
    y = transforms.mapped(first, ["track", "first"], "x", lambda r: {"y": f.run(r["x"], r["state"])}, "y", fill=0.0)
    return layout.unblocked(y, "y")


def high_pass(samples: DataFrame, cutoff: float, block: int = layout.BLOCK) -> DataFrame:
    """Second-order high-pass (Q 0.7071) at ``cutoff`` cycles per sample."""
    return recursive(samples, [high_pass_section(cutoff, 0.70710678)], block)


def loudness(samples: DataFrame, rate: float, cell: int | None = None, absolute: float = -70.0, relative: float = -10.0, range_relative: float = -20.0) -> DataFrame:
    """track, loudness (LUFS), lra (LU), blocks of K-weighted samples (full scale 1).

    Loudness is that of blocks of four cells (a cell is 100 ms), one a cell, above an absolute gate and one ``relative``
    below what passes it; null where no block does.  The range is p95 - p10 of the gated loudness of windows of 30 cells,
    one every ten, above the absolute gate and one ``range_relative`` below their power mean; 0 where there is none.
    """
    cell = cell or round(rate / 10)
    blocks = layout.kept_blocks(samples, "x")
    y = recursive(blocks, k_weighting(rate))
    cells = y.groupBy("track", F.floor(F.col("ix") / cell).alias("c")).agg(F.sum(F.col("y") * F.col("y")).alias("e0"), F.count("*").alias("n")).where(F.col("n") == cell)
    g = layout.lagged(layout.cut(cells.drop("n")), ["track"], "c", e1=("e0", 1), e2=("e0", 2), e3=("e0", 3)).where(F.col("e3").isNotNull())
    level = lambda p: -0.691 + 10 * F.log10(p)
    g = layout.cut(g.select("track", (F.col("c") - 3).alias("c"), ((F.col("e3") + F.col("e2") + F.col("e1") + F.col("e0")) / (4 * cell)).alias("p")))
    heard = g.where((F.col("p") > 0) & (level(F.col("p")) > absolute))
    gate = heard.groupBy("track").agg((level(F.avg("p")) + relative).alias("gate"))
    whole = heard.join(gate, "track").where(level(F.col("p")) > F.col("gate")).groupBy("track").agg(level(F.avg("p")).alias("loudness"), F.count("*").alias("blocks"))

    # a window holds the blocks that begin in its first 27 cells; each block is in three windows at most
    at = F.explode(F.sequence(F.greatest(F.ceil((F.col("c") - 26) / 10), F.lit(0)), F.floor(F.col("c") / 10))).alias("w")
    some = g.where(F.col("c") >= 0).where(F.ceil((F.col("c") - 26) / 10) <= F.floor(F.col("c") / 10))
    windows = some.select("track", at, "p").groupBy("track", "w").agg(F.collect_list("p").alias("ps")).where(F.size("ps") == 27)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, p: s + p) / F.size(a)
    first = F.filter("ps", lambda p: (p > 0) & (level(p) > absolute))
    windows = windows.withColumn("ps", first).where(F.size("ps") > 0).withColumn("gate", level(mean(F.col("ps"))) + relative)
    windows = windows.withColumn("ps", F.filter("ps", lambda p: level(p) > F.col("gate"))).withColumn("p", mean(F.col("ps"))).where(level(F.col("p")) > absolute)
    windows = layout.cut(windows.select("track", "p"))
    low = windows.groupBy("track").agg((level(F.avg("p")) + range_relative).alias("gate"))
    q = layout.quantiles(windows.join(low, "track").where(level(F.col("p")) > F.col("gate")).select("track", level(F.col("p")).alias("l")), ["track"], "l", hi=0.95, lo=0.1)
    tracks = blocks.select("track").distinct()
    return tracks.join(whole, "track", "left").join(q, "track", "left").select("track", "loudness", F.coalesce(F.col("hi") - F.col("lo"), F.lit(0.0)).alias("lra"), F.coalesce("blocks", F.lit(0)).alias("blocks"))


def kaiser_low_pass(taps: int, cutoff: float, beta: float = 8.0) -> np.ndarray:
    """Linear-phase low-pass of an odd number of taps that add up to 1; ``cutoff`` in cycles per sample."""
    if taps % 2 == 0 or not 0 < cutoff < 0.5:
        raise ValueError(f"taps must be odd and the cutoff between 0 and 0.5, got {taps} and {cutoff}")
    t = np.arange(taps) - taps // 2
    h = 2 * cutoff * np.sinc(2 * cutoff * t) * np.kaiser(taps, beta)
    return h / h.sum()


def convolved(samples: DataFrame, taps: np.ndarray, block: int = layout.BLOCK) -> DataFrame:
    """track, ix, y: samples through a symmetric filter without its delay; silence outside the track."""
    half = len(taps) // 2
    return transforms.by_block(samples, lambda x, at: {"y": np.convolve(x, taps)[half : half + len(x)]}, "y double", half, block)


def convolved_blocks(blocks: DataFrame, taps: np.ndarray, name: str = "y", block: int = layout.BLOCK) -> DataFrame:
    """Blocks with ``name``, their ``x`` as ``convolved`` gives it."""
    half = len(taps) // 2

    def kernel(r: dict) -> dict[str, np.ndarray]:
        own = slice(r["at"], r["at"] + r["n"])
        return {"_x": r["x"][own], name: np.convolve(r["x"], taps)[half : half + len(r["x"])][own]}

    halo = layout.haloed(blocks, half, half, "x", block=block).withColumn("_own", F.col("first") + F.col("at"))
    return transforms.mapped(halo, ["track", "blk", "_own"], "x", kernel, "_x", name).select("track", "blk", F.col("_own").alias("first"), F.col("_x").alias("x"), name)


def split_bands(samples: DataFrame, cutoff: float, taps: int = 511, block: int = layout.BLOCK) -> DataFrame:
    """track, ix, low, high: complementary bands, whose sum is the sample."""
    h, half = kaiser_low_pass(taps, cutoff), taps // 2

    def kernel(x: np.ndarray, at: int) -> dict[str, np.ndarray]:
        low = np.convolve(x, h)[half : half + len(x)]
        return {"low": low, "high": x - low}

    return transforms.by_block(samples, kernel, "low double, high double", half, block)


def recombined(below: DataFrame, above: DataFrame, cutoff: float, taps: int = 511, block: int = layout.BLOCK) -> DataFrame:
    """track, ix, x: the low band of one rendering and the high band of another, over the positions that both have."""
    low, high = split_bands(below, cutoff, taps, block), split_bands(above, cutoff, taps, block)
    return low.select("track", "ix", "low").join(high.select("track", "ix", "high"), ["track", "ix"]).select("track", "ix", (F.col("low") + F.col("high")).alias("x"))


def rate_taps(up: int, down: int, zeros: int = 16, beta: float = 12.0) -> np.ndarray:
    """The filter of ``resampled``, at ``up`` times the input rate: its gain is ``up``, it passes what both rates can hold."""
    half = zeros * max(up, down)
    t = np.arange(-half, half + 1)
    return up / max(up, down) * np.sinc(t / max(up, down)) * np.kaiser(2 * half + 1, beta)


def resampled(samples: DataFrame, up: int, down: int, zeros: int = 16, block: int = layout.BLOCK) -> DataFrame:
    """track, ix, y at up / down times the rate, by a polyphase filter on the track's own grid: output m is at input time
    m * down / up.  Silence outside the track; an input of n samples gives ceil(n * up / down)."""
    common = math.gcd(up, down)
    up, down = up // common, down // common
    h = rate_taps(up, down, zeros)
    half = len(h) // 2
    reach = half // up + 1
    halo = layout.with_halo(samples.select("track", "ix", "x"), reach, reach, block=block)
    per = 2 * half // up + 2  # inputs under the filter

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("ix")
        ix, x, own = df["ix"].to_numpy(), df["x"].to_numpy(float), df["_own"].to_numpy()
        first, last = int(ix[own][0]), int(ix[own][-1])
        m = np.arange(-(-first * up // down), -(-(last + 1) * up // down))
        low = -(-(m * down - half) // up)  # the first input under the filter
        k = low[:, None] + np.arange(per)
        tap = m[:, None] * down - k * up + half
        there = (k >= ix[0]) & (k <= ix[-1]) & (tap >= 0) & (tap < len(h))
        y = np.where(there, x[np.clip(k - ix[0], 0, len(x) - 1)] * h[np.clip(tap, 0, len(h) - 1)], 0.0).sum(axis=1)
        return pd.DataFrame({"track": df["track"].iloc[0], "ix": m, "y": y})

    return halo.groupBy("track", "_blk").applyInPandas(run, f"track {dict(samples.dtypes)['track']}, ix long, y double")
