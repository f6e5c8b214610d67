"""Loudness and masking in critical bands, as expressions over arrays of bin powers."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Slopes of excitation towards lower and higher bands, in dB a Bark.
BELOW_DB, ABOVE_DB = 27.0, 12.0
#: Level (dB) of a power of 1.
FULL_SCALE_DB = 60.0


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once a row, however often it is used."""
    return F.transform(F.array(value), then)[0]


def bark(hz: float) -> float:
    return 13 * math.atan(0.00076 * hz) + 3.5 * math.atan((hz / 7500) ** 2)


def quiet_db(hz: float) -> float:
    k = max(hz, 20.0) / 1000
    return 3.64 * k**-0.8 - 6.5 * math.exp(-0.6 * (k - 3.3) ** 2) + 1e-3 * k**4


def bands(bins: int, rate: float) -> list[tuple[int, int]]:
    """(first bin, bins) of each critical band that has a bin, of a spectrum of ``bins`` bins up to half the rate."""
    width = rate / 2 / (bins - 1)
    of = [int(bark(i * width)) for i in range(bins)]
    return [(of.index(b), of.count(b)) for b in sorted(set(of))]


def centres(bins: int, rate: float) -> list[float]:
    """Middle frequency (Hz) of the bins of each band."""
    width = rate / 2 / (bins - 1)
    return [(a + (n - 1) / 2) * width for a, n in bands(bins, rate)]


def band_powers(p: Column, bins: int, rate: float) -> Column:
    return _once(p, lambda v: F.array(*[F.aggregate(F.slice(v, a + 1, n), F.lit(0.0), lambda s, x: s + x) for a, n in bands(bins, rate)]))


def excitation(powers: Column, bins: int, rate: float) -> Column:
    """Band powers spread over their neighbours: what each band gets from every other falls by the slopes."""
    z = [bark(hz) for hz in centres(bins, rate)]
    rows = [[10 ** (-(BELOW_DB * (zi - zj) if zi > zj else ABOVE_DB * (zj - zi)) / 10) for zi in z] for zj in z]
    return _once(powers, lambda e: F.array(*[sum((e[i] * w for i, w in enumerate(row)), F.lit(0.0)) for row in rows]))


def specific_loudness(level_db: Column, threshold_db: Column | float) -> Column:
    """Sone a Bark of an excitation level over its threshold in quiet (Zwicker and Fastl), 0 below it."""
    t = threshold_db if isinstance(threshold_db, Column) else F.lit(float(threshold_db))
    ratio = F.pow(F.lit(10.0), (level_db - t) / 10)
    return F.greatest(0.08 * F.pow(F.lit(10.0), 0.023 * t) * (F.pow(0.5 + 0.5 * ratio, F.lit(0.23)) - 1), F.lit(0.0))


def loudness(p: Column, bins: int, rate: float, full_scale_db: float = FULL_SCALE_DB) -> Column:
    """Array of specific loudness in each band of a power spectrum."""
    thresholds = [quiet_db(hz) for hz in centres(bins, rate)]
    excited = excitation(band_powers(p, bins, rate), bins, rate)
    return _once(excited, lambda e: F.array(*[specific_loudness(10 * F.log10(e[i] + 1e-12) + full_scale_db, t) for i, t in enumerate(thresholds)]))


def noise_to_mask_db(programme: Column, noise: Column, bins: int, rate: float, offset_db: float = 6.0, full_scale_db: float = FULL_SCALE_DB) -> Column:
    """Largest ratio (dB) over bands of the noise's power to what the programme masks (its excitation less ``offset_db``) or the
    threshold in quiet hides: above 0 it is audible."""
    hidden = [10 ** ((quiet_db(hz) - full_scale_db) / 10) for hz in centres(bins, rate)]
    both = F.struct(excitation(band_powers(programme, bins, rate), bins, rate).alias("mask"), band_powers(noise, bins, rate).alias("own"))
    ratio = lambda b, i, h: 10 * F.log10((b["own"][i] + 1e-12) / F.greatest(b["mask"][i] * 10 ** (-offset_db / 10), F.lit(h)))
    return _once(both, lambda b: F.array_max(F.array(*[ratio(b, i, h) for i, h in enumerate(hidden)])))


def verdict(ratio_db: Column) -> Column:
    return F.when(ratio_db > 0, "audible").when(ratio_db > -10, "marginal").otherwise("inaudible")
