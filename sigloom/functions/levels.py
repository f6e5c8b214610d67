"""Levels, psychoacoustic scales and threshold ladders as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigloom.functions.constants import E1_FAR_ABOVE, E1_FAR_BELOW, E1_NEAR


def amplitude_db(x: Column, floor: float = 1e-12) -> Column:
    return 20 * F.log10(x + floor)


def power_db(x: Column, floor: float = 1e-20) -> Column:
    return 10 * F.log10(F.greatest(x, F.lit(floor)))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def rms(x: str) -> Column:
    return F.sqrt(F.avg(F.col(x) * F.col(x)))


def reduction_db(floor_db: Column) -> Column:
    """Noise reduction for a noise floor: fixed ladder."""
    return F.when(floor_db < -60, 8.0).when(floor_db < -45, 11.0).when(floor_db < -35, 13.5).otherwise(16.0)


def rumble_highpass(share: Column) -> Column:
    """High-pass corner for the share of power below 70 Hz: fixed ladder."""
    return F.when(share > 0.3, 75).when(share > 0.1, 60).when(share > 0.02, 45).otherwise(0)


def erb_number(hz: Column) -> Column:
    """Number of equivalent rectangular bandwidths below a frequency."""
    return 21.4 * F.log10(0.00437 * hz + 1)


def erb_to_hz(erb: Column) -> Column:
    return (F.pow(F.lit(10.0), erb / 21.4) - 1) / 0.00437


def bark(hz: Column) -> Column:
    """Critical-band rate (Zwicker and Terhardt)."""
    return 13 * F.atan(0.00076 * hz) + 3.5 * F.atan(F.pow(hz / 7500, F.lit(2.0)))


def quiet_threshold_db(hz: Column) -> Column:
    """Threshold in quiet (Terhardt)."""
    k = hz / 1000
    return 3.64 * F.pow(k, F.lit(-0.8)) - 6.5 * F.exp(-0.6 * F.pow(k - 3.3, F.lit(2.0))) + 1e-3 * F.pow(k, F.lit(4.0))


def exponential_integral(x: Column) -> Column:
    """E1(x) for x > 0 by the rational and polynomial approximations of Abramowitz and Stegun, 5.1.53 and 5.1.56."""

    def poly(coefficients: tuple[float, ...]) -> Column:
        """Highest power first."""
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * x + c
        return out

    near = poly(E1_NEAR[::-1]) - F.log(x)
    far = poly(E1_FAR_ABOVE) / poly(E1_FAR_BELOW) / (x * F.exp(x))
    return F.when(x < 1, near).otherwise(far)


def lsa_gain(gamma: Column, xi: Column) -> Column:
    """Log-spectral amplitude gain for posterior and prior signal-to-noise ratios."""
    share = xi / (1 + xi)
    nu = F.greatest(share * gamma, F.lit(1e-10))
    return share * F.exp(exponential_integral(nu) / 2)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def log_loss(p: Column, y: Column, edge: float = 1e-12) -> Column:
    q = F.least(F.greatest(p, F.lit(edge)), F.lit(1 - edge))
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def power_spectrum(x: Column, n: int) -> Column:
    """Power of bins 0 to n/2 of an array of ``n`` numbers, without Python: one sum of products a bin."""

    def part(k: Column, wave) -> Column:
        turned = F.transform(x, lambda v, i: v * wave(k * i * F.lit(2 * math.pi / n)))
        return F.aggregate(turned, F.lit(0.0), lambda s, v: s + v)

    return F.transform(F.sequence(F.lit(0), F.lit(n // 2)), lambda k: F.pow(part(k, F.cos), F.lit(2.0)) + F.pow(part(k, F.sin), F.lit(2.0)))
