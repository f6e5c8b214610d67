"""Defects injected into recordings, each a function of a sample's absolute position and a seed, so that a rerun, another cut into
blocks or a lost task gives the same samples.  They are what detectors are tested on."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.operators import filters, layout

PRIME = (1 << 31) - 1


def uniform(at: Column, seed: int) -> Column:
    """A number from 0 to 1 for each position: whole-number steps modulo a prime, so that every engine agrees."""
    u = F.pmod(at * 48271 + F.lit(seed * 16807 + 11), F.lit(PRIME))
    u = F.pmod(u * 69621 + 7, F.lit(PRIME))
    u = F.pmod(u * u, F.lit(PRIME))
    return F.pmod(u * 39373 + 3, F.lit(PRIME)) / float(PRIME)


def gaussian(at: Column, seed: int) -> Column:
    """Box and Muller's transform of two uniform numbers."""
    u, v = uniform(at, seed), uniform(at, seed + 7919)
    return F.sqrt(-2 * F.log(u + 1.0 / PRIME)) * F.cos(2 * math.pi * v)


def _wave(freq: float) -> Column:
    return F.sin(F.pmod(F.col("ix") * F.lit(freq), F.lit(1.0)) * (2 * math.pi))


def hum(level: float = 0.1, freq: float = 0.1, harmonics: int = 3) -> Column:
    return F.col("x") + sum((_wave(freq * h) * (level / h) for h in range(2, harmonics + 1)), _wave(freq) * level)


def crackle(level: float = 1.0, share: float = 0.01, seed: int = 1) -> Column:
    ix = F.col("ix")
    return F.col("x") + F.when(uniform(ix, seed) < share, F.when(uniform(ix, seed + 1) < 0.5, -level).otherwise(level)).otherwise(0.0)


def dropouts(length: int = 16, share: float = 0.1, left: float = 0.0, seed: int = 2) -> Column:
    return F.col("x") * F.when(uniform(F.floor(F.col("ix") / length), seed) < share, left).otherwise(1.0)


def tape_noise(level: float = 0.05, seed: int = 3) -> Column:
    return F.col("x") + gaussian(F.col("ix"), seed) * level


def clipping(limit: float = 0.5) -> Column:
    return F.greatest(F.least(F.col("x"), F.lit(limit)), F.lit(-limit))


def offset(dc: float = 0.1) -> Column:
    return F.col("x") + dc


def rumble(level: float = 0.2, freq: float = 0.003) -> Column:
    return F.col("x") + _wave(freq) * level


def whistle(level: float = 0.1, freq: float = 0.35) -> Column:
    return F.col("x") + _wave(freq) * level


def quantised(bits: int = 4) -> Column:
    return F.rint(F.col("x") * (1 << (bits - 1))) / (1 << (bits - 1))


def gated(limit: float = 0.1) -> Column:
    return F.when(F.abs("x") < limit, 0.0).otherwise(F.col("x"))


def fluctuating(depth: float = 0.5, freq: float = 0.01) -> Column:
    return F.col("x") * (1 - depth * (0.5 + 0.5 * _wave(freq)))


def inverted() -> Column:
    return -F.col("x")


#: Defects that look at one sample and its position.
POINTWISE: dict[str, Callable[..., Column]] = {
    "hum": hum, "crackle": crackle, "dropouts": dropouts, "tape_noise": tape_noise, "clipping": clipping, "offset": offset, "rumble": rumble,
    "whistle": whistle, "quantised": quantised, "gated": gated, "fluctuating": fluctuating, "inverted": inverted,
}


def echo(samples: DataFrame, delay: int = 40, gain: float = 0.5) -> DataFrame:
    out = layout.lagged(samples.select("track", "ix", "x"), ["track"], then=("x", delay))
    return out.select("track", "ix", (F.col("x") + gain * F.coalesce("then", F.lit(0.0))).alias("x"))


def dull(samples: DataFrame, cutoff: float = 0.1, taps: int = 63) -> DataFrame:
    """What is above ``cutoff`` is lost."""
    return filters.convolved(samples, filters.kaiser_low_pass(taps, cutoff)).select("track", "ix", F.col("y").alias("x"))


def wobble(samples: DataFrame, depth: float = 2.0, freq: float = 0.001) -> DataFrame:
    """Speed that wobbles: each sample is read ``depth`` * sin(2 pi freq ix) later, between the two nearest samples."""
    reach = math.ceil(depth) + 1
    at = F.col("ix") + depth * _wave(freq)
    wanted = samples.select("track", "ix", at.alias("at")).withColumn("k", F.floor("at")).withColumn("part", F.col("at") - F.col("k"))
    near = samples.select("track", F.col("ix").alias("k"), F.col("x").alias("a"))
    pairs = layout.lagged(near.withColumnRenamed("k", "ix"), ["track"], b=("a", -1)).select("track", F.col("ix").alias("k"), "a", F.coalesce("b", "a").alias("b"))
    held = wanted.withColumn("k", F.greatest(F.col("k"), F.lit(0)))
    out = held.join(pairs, ["track", "k"], "left").select("track", "ix", "k", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("x"))
    # a sample read from beyond the end is silent
    return out.where(F.abs(F.col("k") - F.col("ix")) <= reach + 1).select("track", "ix", F.coalesce("x", F.lit(0.0)).alias("x"))


WHOLE: dict[str, Callable[..., DataFrame]] = {"echo": echo, "dull": dull, "wobble": wobble}


def injected(samples: DataFrame, name: str, **how) -> DataFrame:
    """track, ix, x with the named defect, its level and seed as arguments; raises KeyError for an unknown one."""
    if name in POINTWISE:
        return samples.select("track", "ix", POINTWISE[name](**how).alias("x"))
    return WHOLE[name](samples, **how)
