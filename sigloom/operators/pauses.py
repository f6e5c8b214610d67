"""Pauses: windows picked from the quietest stretches, and the hiss that is left in them.

Frames come from ``renditions.framed``; what is read of them are band powers.  Every window here has a bounded reach, and the
greedy pick of windows that don't overlap goes block by block, in as many rounds as one choice can reach over blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions import hearing
from sigloom.operators import layout, renditions, spectra

#: Bands of one ERB between these (Hz); hiss counts from HISS_FROM on, blocks are judged silent from SILENT_FROM on.
LOW, TOP, HISS_FROM, SILENT_FROM = 50.0, 16000.0, 2000.0, 1000.0
#: Room tone: where it is first heard, and where its level is compared.
ROOM_ONSET, ROOM_LEVEL = (100.0, 2000.0), (100.0, 1500.0)
#: The weight of hiss is a half at its centre and falls by e over so many octaves.
CENTRE, WIDTH_OCTAVES = 3150.0, 0.15
#: Margin (dB) below the threshold in quiet, range of a reading, bins that count as one free value, bands averaged.
QUIET_MARGIN, RANGE_DB, CORRELATED, SMOOTH = 3.0, 140.0, 1.5, 5


def window_levels(samples: DataFrame, hop: int, hops: int) -> DataFrame:
    """track, ix (in hops), level: root mean square of windows ``hops`` hops long, one at every whole hop."""
    x = F.col("x").cast("double")
    e = samples.groupBy("track", F.floor(F.col("ix") / hop).alias("ix")).agg(F.avg(x * x).alias("e"), F.count("*").alias("n")).where(F.col("n") == hop)
    w = layout.in_block(["track"]).rowsBetween(0, hops - 1)
    full = layout.own(layout.with_halo(layout.cut(e.select("track", "ix", "e")), 0, hops - 1).withColumns({"m": F.avg("e").over(w), "c": F.count("*").over(w)}))
    return full.where(F.col("c") == hops).select("track", "ix", F.sqrt("m").alias("level"))


def _settled(rows: pd.DataFrame, reach: int) -> pd.DataFrame:
    """Own rows of a block (track, ix, level, picked, _own) that are picked or still open once all that can be said here is."""
    rows = rows.sort_values(["level", "ix"], kind="stable")
    at = (rows["ix"] - rows["ix"].min()).to_numpy() + reach
    blocked, waits = (np.zeros(at.max() + reach + 1, dtype=bool) for _ in range(2))
    picked, own = rows["picked"].to_numpy(), rows["_own"].to_numpy()
    for p in at[picked]:
        blocked[p - reach + 1 : p + reach] = True
    keep, chosen = picked & own, picked.copy()
    for i in np.flatnonzero(~picked):
        p = at[i]
        if blocked[p]:
            continue
        keep[i] = own[i]
        if own[i] and not waits[p]:
            chosen[i] = True
            blocked[p - reach + 1 : p + reach] = True
        else:  # something before it is not settled, or what lies beyond the block can't be seen
            waits[p - reach + 1 : p + reach] = True
    return pd.DataFrame({"track": rows["track"], "ix": rows["ix"], "level": rows["level"], "picked": chosen})[keep]


def apart(candidates: DataFrame, reach: int, block: int = layout.BLOCK) -> DataFrame:
    """track, ix, level of the candidates that a greedy pick takes: lowest level first, ties by position, each at least ``reach``
    positions from all taken before.

    A candidate depends on lower ones within reach alone.  A block settles all it can with the rows around it; what waits for
    another block is settled in the next round, so rounds follow the longest chain of falling levels over blocks.  In every round
    the lowest open candidate of all is settled, so they end.  Null levels are no candidates.
    """
    kind = dict(candidates.dtypes)
    state = layout.cut(candidates.where(F.col("level").isNotNull() & ~F.isnan("level")).select("track", F.col("ix").cast("long").alias("ix"), F.col("level").cast("double").alias("level"), F.lit(False).alias("picked")))
    schema = f"track {kind['track']}, ix long, level double, picked boolean"
    while not state.where(~F.col("picked")).isEmpty():
        near = layout.with_halo(state, reach - 1, reach - 1, block=block)
        state = layout.cut(near.groupBy("track", "_blk").applyInPandas(lambda rows: _settled(rows, reach), schema))
    return state.drop("picked")


def spread(picks: DataFrame, count: int) -> DataFrame:
    """``count`` of each track's picks (all, if fewer), evenly spaced in order of their level, the lowest and the highest among them."""
    order = F.floor(80 * F.log10(F.col("level") + 1e-12))
    placed = layout.cut(layout.numbered(picks, ["track"], ["level", "ix"], order, "_k"))
    c = placed.groupBy("track").agg(F.count("*").alias("_m")).withColumn("_c", F.least(F.lit(count), F.col("_m")))
    wanted = F.when(F.col("_c") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.expr("transform(sequence(0, _c - 1), i -> (i * (_m - 1)) div (_c - 1))"))
    chosen = c.where(F.col("_c") > 0).select("track", F.explode(wanted).alias("_k"))
    return placed.join(chosen, ["track", "_k"]).drop("_k")


def pause_windows(samples: DataFrame, hop: int, hops: int = 3, count: int = 8, share: float = 0.2) -> DataFrame:
    """track, start, stop, level: windows spread evenly by level over the quietest ``share`` of each track's, none over another."""
    levels = layout.cut(window_levels(samples, hop, hops))
    low = levels.join(layout.quantiles(levels, ["track"], "level", q=share), "track").where("level <= q").drop("q")
    return spread(apart(low, hops), count).select("track", (F.col("ix") * hop).alias("start"), ((F.col("ix") + hops) * hop).alias("stop"), "level")


def bands_of(rate: float, frame: int) -> list[tuple[float, float, list[int]]]:
    """(lo, hi, bins) of the bands that hold a bin."""
    edges = renditions.erb_edges(LOW, min(TOP, rate / 2))
    return [b for b in ((lo, hi, renditions.bins_within(lo, hi, rate, frame)) for lo, hi in zip(edges, edges[1:])) if b[2]]


def median_share(k: float, z: float = 0.0) -> float:
    """Median (z = 0, or another normal quantile) over mean of a Gamma of shape ``k``, by Wilson and Hilferty."""
    return max(1 - 1 / (9 * k) + z / (3 * math.sqrt(k)), 0.05) ** 3


def hiss_weight(hz: float) -> float:
    return 1 / (1 + math.exp(-math.log2(max(hz, 1.0) / CENTRE) / WIDTH_OCTAVES))


def critical_rate(hz: float) -> float:
    """Critical-band rate by Traunmueller."""
    return 26.81 * hz / (1960 + hz) - 0.53


def steady_levels(frames: DataFrame, rate: float, frame: int, segment: int, blocks: int = 5, spread_db: float = 3.0, share: float = 0.5, low: float = 0.25) -> DataFrame:
    """track, band, level: what a band of ``frames`` (track, f, src: array) never falls below for long, as a power a frame.

    A segment has ``blocks`` blocks of frames; the valley of a block is its ``low`` quantile, raised to the mean that noise with such a
    quantile has.  A band is steady in a segment whose valleys lie within ``spread_db``; where it is steady in ``share`` of the
    segments, its level is the median of theirs.  Segments with a block that isn't whole are left out.
    """
    size = segment // blocks
    long_ = frames.select("track", F.floor(F.col("f") / size).alias("b"), F.posexplode("src").alias("band", "e"))
    v = long_.groupBy("track", "b", "band").agg(F.percentile("e", low).alias("v"), F.count("*").alias("n")).where(F.col("n") == size)  # a block's frames
    shares = [median_share(max(len(b) / CORRELATED, 0.5), -0.6744897501960817) for *_, b in bands_of(rate, frame)]
    v = layout.cut(v.withColumn("v", F.col("v") / F.array(*map(F.lit, shares))[F.col("band")]))
    s = v.groupBy("track", "band", F.floor(F.col("b") / blocks).alias("s")).agg(F.percentile("v", 0.5).alias("level"), (renditions.decibel(F.max("v")) - renditions.decibel(F.min("v"))).alias("wide"), F.count("*").alias("n")).where(F.col("n") == blocks)
    s = layout.cut(s.withColumn("steady", F.col("wide") <= spread_db))
    kept = s.groupBy("track", "band").agg(F.avg(F.col("steady").cast("double")).alias("share")).where(F.col("share") >= share).select("track", "band")
    return layout.quantiles(s.where("steady").select("track", "band", "level"), ["track", "band"], "level", level=0.5).join(kept, ["track", "band"])


def true_pauses(frames: DataFrame, shortest: int, smooth: int = 3, reach: int = 4, margin_db: float = 6.0, quiet: float = 0.2) -> DataFrame:
    """track, f: quiet frames of ``frames`` (track, f, level, vad) inside stretches of ``shortest`` frames or more without programme."""
    q = layout.quantiles(frames, ["track"], "level", q=quiet)
    speech = renditions.programme(frames.select("track", "f", "vad"), smooth, reach, margin_db)
    s = layout.cut(frames.select("track", "f", "level").join(speech, ["track", "f"]).join(q, "track").select("track", "f", (~F.col("speech")).cast("int").alias("still"), (F.col("level") <= F.col("q")).alias("quiet")))
    w = layout.in_block(["track"], "f")
    begins = (F.min("still").over(w.rowsBetween(0, shortest - 1)) == 1) & (F.count("*").over(w.rowsBetween(0, shortest - 1)) == shortest)
    halo = layout.with_halo(s, shortest - 1, shortest - 1, "f").withColumn("begins", begins)
    inside = layout.own(halo.withColumn("inside", F.bool_or("begins").over(w.rowsBetween(-(shortest - 1), 0))))
    return inside.where(F.col("quiet") & F.col("inside")).select("track", "f")


def _parts(masked: DataFrame, block: int, tail: int, many: int = 512) -> DataFrame:
    """track, at, f, per: frames of the blocks that runs of masked frames are cut into (a last one of ``tail`` frames or more), or every
    frame for itself in a track without any; per is the number of frames a block stands for."""
    runs = layout.runs(masked.withColumn("on", F.lit(True)), ["track"], "on", "f").withColumn("n", F.ceil(F.col("length") / block))
    groups = runs.withColumn("g", F.explode(F.expr(f"sequence(0L, (n - 1) div {many})")))
    each = groups.withColumn("j", F.explode(F.expr(f"sequence(g * {many}, least(g * {many} + {many - 1}, n - 1))")))
    cut = each.select("track", (F.col("start") + F.col("j") * block).alias("at"), F.least(F.col("start") + (F.col("j") + 1) * block, F.col("stop")).alias("end")).where(F.col("end") - F.col("at") >= tail)
    whole = layout.cut(cut.select("track", "at", F.explode(F.expr("sequence(at, end - 1)")).alias("f"), F.lit(block).alias("per")))
    lone = masked.join(whole.select("track").distinct(), "track", "left_anti").select("track", F.col("f").alias("at"), "f", F.lit(1).alias("per"))
    return whole.unionByName(lone)


def _smoothed(a: Column, n: int) -> Column:
    """Power mean (dB) of each band and its neighbours that hold something; beyond an end its band goes on."""
    half = SMOOTH // 2

    def at(v: Column, i: int) -> Column:
        near = [v[min(max(i + d, 0), n - 1)] for d in range(-half, half + 1)]
        total = sum((F.coalesce(F.pow(F.lit(10.0), x / 10), F.lit(0.0)) for x in near), F.lit(0.0))
        held = sum((x.isNotNull().cast("int") for x in near), F.lit(0))
        return F.when(v[i].isNotNull(), 10 * F.log10(total / held))

    return F.transform(F.array(a), lambda v: F.array(*[at(v, i) for i in range(n)]))[0]


def hiss_in_pauses(
    pairs: DataFrame, rate: float, frame: int, shortest: int = 10, block: int = 10, tail: int = 5, least: int = 25, segment: int | None = 750, quiet: float = 0.2, loud: float = 0.7,
    programme_db: float = 3.0, level_db: float = 75.0, smooth: int = 3, reach: int = 4, margin_db: float = 6.0, spectrum: renditions.Spectrum = spectra.power,
) -> DataFrame:
    """track, pause_frames, and of both sides margin_db, sone and room_onset_db, room_delta_db, reason: the noise left in the pauses.

    The pauses are the source's.  A band's floor is the median over blocks of a pause, raised to the mean of noise; blocks whose source
    stands ``programme_db`` over its steady level (``steady_levels`` over segments of so many frames; None: none is known) hold
    soft programme and count on neither side.  Against the loud frames of its own side, played at ``level_db``, and weighted as
    tape hiss is, margin_db is how far the floor stands over the threshold in quiet (below nought it can't be heard), sone how loud it
    is; room_onset_db is the playback level at which the bands of rooms turn audible, room_delta_db what they
    gained.  Tracks with fewer than ``least`` frames of pauses, or with programme in all of them, have a reason
    instead.  Tones are not taken out first.  Defaults are for frames of 20 ms.
    """
    bands = bands_of(rate, frame)
    n = len(bands)
    scale = 2 / (frame * float((spectra.hann(frame) ** 2).sum()))
    pairs = layout.kept_blocks(pairs, "src", "out")
    f = renditions.framed(pairs, frame)
    p = f.select("track", "f", "level", F.sqrt(F.aggregate("out", F.lit(0.0), lambda a, x: a + x * x) / frame).alias("out_level"), spectrum(F.col("src"), frame).alias("s"), spectrum(F.col("out"), frame).alias("o"))
    vad = F.array(*[renditions.energy(F.col("s"), b) for b in (renditions.bins_within(*r, rate, frame) for r in renditions.ACTIVE_BANDS) if b])
    arrays = [(F.array(*[renditions.energy(F.col(c), b) * scale for *_, b in bands])).alias(name) for c, name in (("s", "src"), ("o", "out"))]
    read = layout.cut(p.select("track", "f", "level", "out_level", *arrays, vad.alias("vad")))

    q = layout.quantiles(read, ["track"], "level", q=loud).join(layout.quantiles(read, ["track"], "out_level", r=loud), "track")
    power = lambda c, bar: 10 * F.log10(F.avg(F.when(F.col(c) >= F.col(bar), F.col(c) * F.col(c))) + renditions.TINY)
    louds = read.join(q, "track").groupBy("track").agg(power("level", "q").alias("src_loud"), power("out_level", "r").alias("out_loud"))

    masked = layout.cut(true_pauses(read.select("track", "f", "level", "vad"), shortest, smooth, reach, margin_db, quiet))
    rows = _parts(masked, block, tail).join(read.select("track", "f", "src", "out"), ["track", "f"])
    means = rows.select("track", "at", "per", F.posexplode(F.arrays_zip("src", "out")).alias("band", "e")).groupBy("track", "at", "per", "band").agg(F.avg("e.src").alias("src"), F.avg("e.out").alias("out"))
    centres = [math.sqrt(lo * hi) for lo, hi, _ in bands]
    if segment is not None:
        judged = F.col("band").isin(*[i for i, c in enumerate(centres) if c >= SILENT_FROM])
        steady = steady_levels(read, rate, frame, segment)
        stands = F.col("src") >= F.col("level") * 10 ** (programme_db / 10)
        means = means.join(steady, ["track", "band"], "left").where(~(judged & F.coalesce(stands, F.lit(False)))).drop("level")
    means = layout.cut(means.select("track", "per", "band", "src", "out"))
    keys = ["track", "per", "band"]
    floors = layout.quantiles(means, keys, "src", src=0.5).join(layout.quantiles(means, keys, "out", out=0.5), keys)
    shape = F.array(*[F.lit(max(len(b) / CORRELATED, 0.5)) for *_, b in bands])[F.col("band")] * F.col("per")
    share = F.pow(F.greatest(1 - 1 / (9 * shape), F.lit(0.05)), F.lit(3.0))
    entries = lambda c: F.map_from_entries(F.collect_list(F.struct("band", (F.col(c) / share).alias("v"))))
    per = floors.groupBy("track").agg(entries("src").alias("_src"), entries("out").alias("_out")).join(louds, "track")  # a few bands a track
    rel = lambda s: F.array(*[F.when(F.try_element_at(f"_{s}", F.lit(i)) > 0, 10 * F.log10(F.try_element_at(f"_{s}", F.lit(i))) - F.col(f"{s}_loud")) for i in range(n)])
    per = per.withColumns({s: rel(s) for s in ("src", "out")})

    hiss = [i for i, c in enumerate(centres) if c >= HISS_FROM]
    hush = [hearing.quiet_db(c) - QUIET_MARGIN for c in centres]
    onset = [i for i, c in enumerate(centres) if ROOM_ONSET[0] <= c < ROOM_ONSET[1]]
    room = [i for i, c in enumerate(centres) if ROOM_LEVEL[0] <= c < ROOM_LEVEL[1]]

    def most(values: list[Column]) -> Column:
        return F.array_max(F.array(*values, F.lit(None).cast("double")))

    def margin(s: str) -> Column:
        weighted = F.array(*[F.col(s)[i] + 10 * math.log10(hiss_weight(c)) for i, c in enumerate(centres)])
        above = F.transform(F.array(_smoothed(weighted, n)), lambda v: most([level_db + v[i] - hush[i] for i in hiss]))[0]
        return F.greatest(F.coalesce(above, F.lit(level_db - RANGE_DB)), F.lit(level_db - RANGE_DB))

    def sone(s: str) -> Column:
        width = [critical_rate(hi) - critical_rate(lo) for lo, hi, _ in bands]
        return sum((F.coalesce(hearing.specific_loudness(F.col(s)[i] + level_db, hush[i]), F.lit(0.0)) * width[i] * hiss_weight(centres[i]) for i in hiss), F.lit(0.0))

    def first_heard(s: str) -> Column:
        return F.coalesce(-most([F.col(s)[i] - hush[i] for i in onset]), F.lit(RANGE_DB)) if onset else F.lit(RANGE_DB)

    def room_level(s: str) -> Column:
        return 10 * F.log10(sum((F.coalesce(F.try_element_at(f"_{s}", F.lit(i)), F.lit(0.0)) for i in room), F.lit(renditions.TINY))) - F.col(f"{s}_loud")

    numbers = {f"{s}_{name}": fn(s) for name, fn in (("margin_db", margin), ("sone", sone), ("room_onset_db", first_heard)) for s in ("src", "out")}
    numbers["room_delta_db"] = room_level("out") - room_level("src") if room else F.lit(None).cast("double")
    known = F.lit(False)
    for i in hiss:
        known = known | F.col("src")[i].isNotNull()
    counts = masked.groupBy("track").agg(F.count("*").alias("pause_frames"))
    all_ = pairs.select("track").distinct().join(counts, "track", "left").join(per, "track", "left").withColumn("pause_frames", F.coalesce("pause_frames", F.lit(0).cast("long")))
    reason = F.when(F.col("pause_frames") < least, "too few pauses").when(~F.coalesce(known, F.lit(False)), "programme in every pause")
    all_ = all_.withColumn("reason", reason)
    return all_.select("track", "pause_frames", *[F.when(F.col("reason").isNull(), c).alias(k) for k, c in numbers.items()], "reason")
