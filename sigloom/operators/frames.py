"""Levels of frames: quiet and loud masks, trade readings, predicates, floors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.functions.levels import amplitude_db, reduction_db
from sigloom.operators import layout


def quiet_loud(frames: DataFrame, level: str, low: float = 0.2, high: float = 0.7, least: int = 8, spread_db: float = 3.0) -> DataFrame:
    """``frames`` with quiet and loud, by percentiles of the track; tracks with few frames or little spread are refused."""
    bounds = layout.quantiles(frames, ["track"], level, p_lo=low, p_hi=high).join(frames.groupBy("track").agg(F.count("*").alias("_n")), "track")
    wide = bounds.where((F.col("_n") >= least) & (amplitude_db(F.col("p_hi")) - amplitude_db(F.col("p_lo")) >= spread_db))
    return frames.join(wide.drop("_n"), "track").withColumns({"quiet": F.col(level) <= F.col("p_lo"), "loud": F.col(level) >= F.col("p_hi")})


def trade(masked: DataFrame) -> DataFrame:
    """track, removed_db, deviation_db: noise taken from quiet frames and change of loud ones, after matching loud levels.

    ``masked`` has ls and lo (levels of source and output) with quiet and loud.  Broadband form.
    """
    energy = lambda c, mask: F.sqrt(F.avg(F.when(F.col(mask), F.col(c) * F.col(c))))
    a = masked.groupBy("track").agg(energy("ls", "quiet").alias("sq"), energy("lo", "quiet").alias("oq"), energy("ls", "loud").alias("sl"), energy("lo", "loud").alias("ol"))
    gain = (F.col("sl") + 1e-12) / (F.col("ol") + 1e-12)
    removed = 20 * F.log10((F.col("sq") + 1e-12) / (F.col("oq") * gain + 1e-12))
    deviation = F.abs(20 * F.log10((F.col("ol") + 1e-12) / (F.col("sl") + 1e-12)))
    return a.select("track", F.round(removed, 3).alias("removed_db"), F.round(deviation, 3).alias("deviation_db"))


def residual_noise(masked: DataFrame) -> DataFrame:
    """track, residual_db: mean output level over mean source level of quiet frames."""
    a = masked.where("quiet").groupBy("track").agg(F.avg("lo").alias("o"), F.avg("ls").alias("s"))
    return a.select("track", F.round(20 * F.log10((F.col("o") + 1e-12) / (F.col("s") + 1e-12)), 4).alias("residual_db"))


def pumping(frames: DataFrame, share: float = 0.15, least: int = 2) -> DataFrame:
    """track, pumping_db: spread (population deviation) of the output's level in the source's quietest frames."""
    q = layout.quantiles(frames, ["track"], "ls", p=share)
    a = frames.join(q, "track").where(F.col("ls") <= F.col("p")).groupBy("track").agg(F.stddev_pop(amplitude_db(F.col("lo"), 1e-9)).alias("d"), F.count("*").alias("n"))
    return a.where(F.col("n") >= least).select("track", F.round("d", 4).alias("pumping_db"))


def median_drop(masked: DataFrame) -> DataFrame:
    """track, drop_db: median over quiet frames of the level drop from source to output."""
    d = masked.where("quiet").select("track", (20 * F.log10((F.col("ls") + 1e-12) / (F.col("lo") + 1e-12))).alias("drop"))
    return layout.quantiles(d, ["track"], "drop", m=0.5).select("track", F.round("m", 4).alias("drop_db"))


def noise_floor(frames: DataFrame, level: str = "level", p: float = 0.1) -> DataFrame:
    """track, floor_db (-80 to -20, one decimal) and the reduction it calls for."""
    q = layout.quantiles(frames, ["track"], level, p=p)
    db = F.bround(F.least(F.greatest(20 * F.log10(F.col("p") + 1e-6), F.lit(-80.0)), F.lit(-20.0)), 1)
    return q.select("track", db.alias("floor_db")).withColumn("reduction", reduction_db(F.col("floor_db")))
