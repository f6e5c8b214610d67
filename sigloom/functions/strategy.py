"""Material, engine and filter-graph decisions as column expressions over a profile row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def material(p: Column | None = None) -> Column:
    """rhythmic, dialogue, music or noise from onset_periodicity, speech_ratio, music_ratio, ambient_ratio, has_dialogue."""
    c = F.col if p is None else lambda k: p[k]
    return (
        F.when(c("onset_periodicity") >= 0.45, "rhythmic")
        .when((c("speech_ratio") >= 0.2) | c("has_dialogue"), "dialogue")
        .when((c("speech_ratio") < 0.15) & ((c("music_ratio") >= 0.15) | (c("ambient_ratio") >= 0.15)), "music")
        .otherwise("noise")
    )


def engine(kind: Column, snr_db: Column) -> Column:
    """Engine for a material: the gentle one where the programme is hardly above the noise, the linear one for speech."""
    return F.when(kind == "rhythmic", "native").when(kind == "dialogue", F.when(snr_db < 10, "hybrid").otherwise("linear")).when(kind == "music", "pure").otherwise("denoise_only")


def graph(*, dc: Column, balance_db: Column, declip: Column, azimuth_ms: Column, highpass_hz: Column, declick: Column, notch_hz: Column, line_hz: Column, resonance_hz: Column) -> Column:
    """Filter graph of a profile, stages in fixed order, joined by commas; ``anull`` when nothing is asked for."""

    def num(x: Column, digits: int) -> Column:
        return F.format_string(f"%.{digits}f", x.cast("double"))

    level = F.when(F.abs(balance_db) > 25, F.when(balance_db > 0, "pan=stereo|c0=c0|c1=c0").otherwise("pan=stereo|c0=c1|c1=c1")).when(
        (F.abs(balance_db) > 0.5) & (F.abs(balance_db) <= 12), F.concat(F.lit("pan=stereo|c0="), num(F.pow(F.lit(10.0), -balance_db / 40), 3), F.lit("*c0|c1="), num(F.pow(F.lit(10.0), balance_db / 40), 3), F.lit("*c1"))
    )
    parts = [
        F.when(dc, "highpass=f=5"),
        level,
        F.when(declip, "adeclip"),
        F.when(azimuth_ms != 0, F.concat(F.lit("adelay="), F.when(azimuth_ms > 0, F.concat(num(azimuth_ms, 3), F.lit("|0"))).otherwise(F.concat(F.lit("0|"), num(-azimuth_ms, 3))))),
        F.when(highpass_hz > 0, F.concat(F.lit("highpass=f="), highpass_hz.cast("string"))),
        F.when(declick, "adeclick"),
        F.when(notch_hz > 0, F.concat(F.lit("bandreject=f="), num(notch_hz, 1), F.lit(":width_type=q:w=15,bandreject=f="), num(notch_hz * 2, 1), F.lit(":width_type=q:w=15"))),
        F.when(line_hz > 0, F.concat(F.lit("bandreject=f="), num(line_hz, 1), F.lit(":width_type=q:w=30"))),
        F.when(resonance_hz > 0, F.concat(F.lit("bandreject=f="), num(resonance_hz, 1), F.lit(":width_type=q:w=12"))),
    ]
    kept = F.array_compact(F.array(*parts))
    return F.when(F.size(kept) == 0, "anull").otherwise(F.array_join(kept, ","))


def expander_points(floor_db: Column, offset: float = 6.0, depth: float = 12.0) -> Column:
    """Points of a downward expander above a noise floor: input/output pairs in dB."""
    knee = F.greatest(F.least(floor_db + offset, F.lit(-35.0)), F.lit(-60.0))
    mid = F.bround((knee - 90) / 2, 1)
    f = lambda x: F.format_string("%.1f", x)
    return F.concat(F.lit("-90/-100|"), f(mid), F.lit("/"), f(mid - depth), F.lit("|"), f(knee), F.lit("/"), f(knee), F.lit("|0/0"))
