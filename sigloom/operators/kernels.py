"""Small numpy kernels for one block of samples.  Spark cuts, deals and joins the blocks; nothing here knows of Spark."""

from __future__ import annotations

import math

import numpy as np

from sigloom.functions.constants import E1_FAR_ABOVE, E1_FAR_BELOW, E1_NEAR


def high_pass(x: np.ndarray, cutoff: float, state: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)) -> tuple[np.ndarray, tuple[float, float, float, float]]:
    """Second-order high-pass (Q 0.7071, cutoff in cycles per sample) and its state after the block."""
    w = 2 * math.pi * cutoff
    alpha, cos = math.sin(w) / (2 * 0.70710678), math.cos(w)
    a0 = 1 + alpha
    b0, b1, a1, a2 = (1 + cos) / 2 / a0, -(1 + cos) / a0, -2 * cos / a0, (1 - alpha) / a0
    x1, x2, y1, y2 = state
    out = np.empty(len(x))
    for i, v in enumerate(x.tolist()):
        y = b0 * v + b1 * x1 + b0 * x2 - a1 * y1 - a2 * y2
        x2, x1, y2, y1 = x1, v, y1, y
        out[i] = y
    return out, (x1, x2, y1, y2)


def cancel_tone(x: np.ndarray, start: int, freq: float, half: int) -> np.ndarray:
    """``x`` less its tone at ``freq`` (cycles per sample): demodulated on the absolute grid, smoothed over 2 * half + 1
    samples, shrunk by its spread, put back and subtracted."""
    t = np.arange(start, start + len(x))
    wave = np.exp(-2j * np.pi * freq * t)
    base = 2 * x * wave

    def box(v: np.ndarray) -> np.ndarray:
        """Sums over the samples within ``half``."""
        return np.convolve(v, np.ones(2 * half + 1))[half : half + len(v)]

    n = box(np.ones(len(x)))
    smooth = box(base) / n
    spread = box(np.abs(base - smooth) ** 2) / n / n
    power = np.abs(smooth) ** 2
    shrunk = smooth * np.maximum(0.0, 1 - 4 * spread / np.maximum(power, 1e-20))
    return x - np.real(shrunk * np.conj(wave))


def lsa_suppress(power: np.ndarray, noise: np.ndarray, floor: float = 0.1, alpha: float = 0.98, least: float = 10 ** (-1.5)) -> np.ndarray:
    """Decision-directed log-spectral gains of consecutive frames (rows) over a noise print."""
    gains, before = np.empty_like(power), None
    for i, p in enumerate(power):
        gamma = p / np.maximum(noise, 1e-20)
        snr = np.maximum(gamma - 1, 0)
        xi = np.maximum(snr if before is None else alpha * before + (1 - alpha) * snr, least)
        nu = np.maximum(xi / (1 + xi) * gamma, 1e-10)
        gains[i] = np.clip(xi / (1 + xi) * np.exp(_e1(nu) / 2), floor, 1)
        before = gains[i] ** 2 * gamma
    return gains


def _e1(x: np.ndarray) -> np.ndarray:
    small = np.polyval(E1_NEAR[::-1], x) - np.log(x)
    far = np.polyval(E1_FAR_ABOVE, x) / np.polyval(E1_FAR_BELOW, x) / (x * np.exp(np.minimum(x, 700)))
    return np.where(x < 1, small, far)


def predictor(x: np.ndarray, order: int) -> np.ndarray:
    """Coefficients of linear prediction from autocorrelations, lightly damped."""
    r = np.array([x[: len(x) - k] @ x[k:] for k in range(order + 1)])
    r[0] = r[0] * (1 + 1e-6) + 1e-12
    return np.linalg.solve(r[np.abs(np.subtract.outer(np.arange(order), np.arange(order)))], r[1:])


def repair_pops(x: np.ndarray, order: int = 8, sigmas: float = 7.0, longest: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(repaired, marks): samples whose prediction residual is beyond ``sigmas`` robust deviations, refilled by least squares."""
    marks = np.zeros(len(x), bool)
    if len(x) <= 4 * order or not np.ptp(x):
        return x, marks
    mean = x.mean()
    y = x - mean
    a = predictor(y, order)
    residual = y[order:] - np.lib.stride_tricks.sliding_window_view(y, order)[:-1][:, ::-1] @ a
    mad = np.median(np.abs(residual - np.median(residual)))
    marks[order:] = np.abs(residual) > sigmas * 1.4826 * mad + 1e-12
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.view(np.int8), [0]])))
    for lo, hi in zip(edges[::2], edges[1::2], strict=True):
        if hi - lo > longest or lo < order or hi + order > len(y):
            marks[lo:hi] = False
            continue
        # unknown samples enter the residuals of rows lo to hi + order; their least squares solution replaces them
        rows = hi - lo + order
        full = np.zeros((rows, hi - lo + 2 * order))
        for k in range(rows):
            full[k, k + order] = 1
            full[k, k : k + order] -= a[::-1]
        known = y[lo - order : hi + order].copy()
        hole = slice(order, order + hi - lo)
        known[hole] = 0
        y[lo:hi] = np.linalg.lstsq(full[:, hole], -(full @ known), rcond=None)[0]
    return y + mean, marks


def warp_path(a: np.ndarray, b: np.ndarray, band: int) -> np.ndarray:
    """(i, j) pairs of the cheapest monotone path between two feature sequences within ``band`` of the diagonal."""
    n, m = len(a), len(b)
    cost = np.full((n + 1, m + 1), np.inf)
    cost[0, 0] = 0
    for i in range(1, n + 1):
        mid = i * m // n
        for j in range(max(1, mid - band), min(m, mid + band) + 1):
            cost[i, j] = abs(a[i - 1] - b[j - 1]) + min(cost[i - 1, j - 1], cost[i - 1, j], cost[i, j - 1])
    i, j, path = n, m, []
    while i and j:
        path.append((i - 1, j - 1))
        i, j = min(((i - 1, j - 1), (i - 1, j), (i, j - 1)), key=lambda s: cost[s])
    return np.array(path[::-1]).reshape(-1, 2)
