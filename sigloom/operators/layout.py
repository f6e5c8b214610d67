"""Order within tracks without whole tracks in one task.

A track (a recording, a user, a supplier) may hold a third of all rows, so no window here is partitioned by track
alone unless all tracks are known to be small.  ``numbered`` counts positions of large tracks in two levels: rows per
bucket, running sums over the buckets, positions inside a bucket.  ``with_halo`` cuts a numbered track into blocks that carry copies of the few rows around them, so that
windows of bounded reach see all they need inside their block.
"""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

#: Positions of a block; halos copy only the rows within reach of a block's ends.
BLOCK = 8192
#: Rows of a key whose quantiles one aggregation finds.
SMALL = 1 << 18
#: Rows of a table that is sent to all tasks.
FEW = 10_000


def numbered(df: DataFrame, keys: list[str], order: list, bucket: Column, name: str = "ix") -> DataFrame:
    """``df`` with ``name``, the position (from 0) of each row of its keys by ``order``; buckets must follow that order.

    Keys of up to ``SMALL`` rows are numbered in one window each, which leaves them dealt by key for what follows.  Larger
    ones are numbered by bucket.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    if (sizes.agg(F.max("_n")).head()[0] or 0) <= SMALL:
        return _numbered_whole(df, keys, order, name)
    large = cut(sizes.where(F.col("_n") > SMALL).select(F.struct(*keys).alias("_key")))  # at most rows / SMALL
    keyed = df.withColumn("_key", F.struct(*keys))
    few = _sent(large)
    small, rest = (keyed.join(few, "_key", how).drop("_key") for how in ("left_anti", "left_semi"))
    return _numbered_whole(small, keys, order, name).unionByName(_numbered_by_bucket(rest, keys, order, bucket, name))


def _numbered_whole(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def _numbered_by_bucket(df: DataFrame, keys: list[str], order: list, bucket: Column, name: str) -> DataFrame:
    # keys and bucket as one struct: null keys are keys like others, and rows are dealt once for the join and the window
    b = df.withColumn("_b", F.struct(*keys, bucket.alias("_b")))
    counts = b.groupBy("_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*[F.col(f"_b.{k}") for k in keys]).orderBy("_b._b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_b").orderBy(*order)
    return b.join(starts, "_b").withColumn(name, F.col("_start") + F.row_number().over(inside) - 1).select(*df.columns, name)


def beside(df: DataFrame, per_key: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` joined with the one row that ``per_key`` has for its keys.

    A few keys would each send all of their rows to one task, so a table of up to ``FEW`` rows goes to the rows instead.
    """
    return df.join(_sent(cut(per_key)), keys)


def with_halo(df: DataFrame, before: int, after: int, ix: str = "ix", block: int = BLOCK) -> DataFrame:
    """Rows with _blk, each also in the blocks whose rows reach it (``before`` back, ``after`` ahead); _own marks its own.

    The number of copies is about (before + after) / block of the rows; ``own`` drops them once windows are done.
    """
    first, last = F.floor((F.col(ix) - after) / block), F.floor((F.col(ix) + before) / block)
    spread = df.withColumn("_blk", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    return spread.withColumn("_own", F.col("_blk") == F.floor(F.col(ix) / block))


def in_block(keys: list[str], ix: str = "ix") -> WindowSpec:
    return Window.partitionBy(*keys, "_blk").orderBy(ix)


def own(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_blk", "_own")


def lagged(df: DataFrame, keys: list[str], ix: str = "ix", **columns: tuple[str, int]) -> DataFrame:
    """``df`` with new columns name=(column, steps): the value ``steps`` positions earlier (later, if negative), else null."""
    back = max([0, *(s for _, s in columns.values())])
    ahead = max([0, *(-s for _, s in columns.values())])
    w = in_block(keys, ix)
    halo = with_halo(df, back, ahead, ix)
    return own(halo.withColumns({k: F.lag(c, s).over(w) if s >= 0 else F.lead(c, -s).over(w) for k, (c, s) in columns.items()}))


def blocked(samples: DataFrame, *columns: str, block: int = BLOCK) -> DataFrame:
    """track, blk, first (position), and ``columns`` as arrays of doubles in order of position; positions have no gaps.

    A sample takes eight bytes a column in an array and several times that as a row, so what moves or keeps whole tracks does
    it in blocks.  Blocks come out as they are; a plan that reads them several times cuts them.
    """
    if "blk" in samples.columns:
        return samples
    rows = samples.select("track", F.floor(F.col("ix") / block).alias("blk"), F.struct(F.col("ix").cast("long").alias("ix"), *[F.col(c).cast("double").alias(c) for c in columns]).alias("_s"))
    held = rows.groupBy("track", "blk").agg(F.sort_array(F.collect_list("_s")).alias("_s"))
    return held.select("track", "blk", F.col("_s")[0]["ix"].alias("first"), *[F.col("_s")[c].alias(c) for c in columns])


def kept_blocks(samples: DataFrame, *columns: str, block: int = BLOCK) -> DataFrame:
    """``blocked``, cut; blocks are taken as they are."""
    return samples if "blk" in samples.columns else cut(blocked(samples, *columns, block=block))


def unblocked(blocks: DataFrame, *columns: str) -> DataFrame:
    """track, ix and ``columns`` of blocks, a row a sample."""
    at = F.posexplode(F.arrays_zip(*columns) if len(columns) > 1 else F.col(columns[0])).alias("_at", "_v")
    rows = blocks.select("track", "first", at)
    return rows.select("track", (F.col("first") + F.col("_at")).alias("ix"), *([F.col("_v")[c].alias(c) for c in columns] if len(columns) > 1 else [F.col("_v").alias(columns[0])]))


def haloed(blocks: DataFrame, before: int, after: int, *columns: str, block: int = BLOCK) -> DataFrame:
    """Blocks whose arrays also hold the samples up to ``before`` ahead of their own and ``after`` behind: track, blk, first (of the
    array), at (where its own begin), n (how many they are) and ``columns``.  Only ends of blocks are copied."""
    first, size, blk = F.col("first"), F.size(columns[0]), F.col("blk")

    def part(d: int) -> Column:
        """What the block ``d`` further on sees of this one."""
        low = F.greatest((blk + d) * block - before - first, F.lit(0)) if d > 0 else F.lit(0)
        high = F.least((blk + d + 1) * block + after - first, size) if d < 0 else size
        whole = [F.slice(c, (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int")).alias(c) if d else F.col(c) for c in columns]
        return F.struct((blk + d).alias("blk"), (first + low).cast("long").alias("first"), F.lit(d == 0).alias("own"), *whole)

    reach = range(-math.ceil(after / block), math.ceil(before / block) + 1)
    parts = blocks.select("track", F.explode(F.array(*[part(d) for d in reach])).alias("p"))
    parts = parts.select("track", "p.*").where((F.size(columns[0]) > 0) & (blk >= 0))
    g = parts.groupBy("track", "blk").agg(F.sort_array(F.collect_list(F.struct("first", "own", *columns))).alias("_p"))
    own = F.filter("_p", lambda p: p["own"])
    g = g.where(F.size(own) == 1).select("track", "blk", F.col("_p")[0]["first"].alias("first"), own[0].alias("_o"), "_p")
    return g.select("track", "blk", "first", (F.col("_o.first") - F.col("first")).alias("at"), F.size(F.col("_o")[columns[0]]).alias("n"), *[F.flatten(F.col("_p")[c]).alias(c) for c in columns])


def slices(blocks: DataFrame, window: int, hop: int, *columns: str, name: str = "f", block: int = BLOCK) -> DataFrame:
    """track, ``name``, ``columns``: whole frames of ``window`` samples of blocks, one every ``hop``, as arrays."""
    near = blocks if block % hop == 0 and window == hop else haloed(blocks, 0, window - 1, *columns, block=block)
    start = F.col("blk") * block
    frames = F.sequence(F.ceil(start / hop), F.floor((start + block - 1) / hop))
    # the arrays as a variable, so that what makes them is not computed again for every frame
    cut_ = F.transform(F.array(F.struct("first", *columns)), lambda s: F.transform(frames, lambda f: F.struct(f.alias(name), *[F.slice(s[c], (f * hop - s["first"] + 1).cast("int"), window).alias(c) for c in columns])))[0]
    some = near.where(F.ceil(start / hop) <= F.floor((start + block - 1) / hop))
    return some.select("track", F.explode(F.filter(cut_, lambda f: F.size(f[columns[0]]) == window)).alias("_f")).select("track", "_f.*")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, which the cluster names in ``spark.checkpoint.dir``; only a local session,
    where both are one machine, may leave it unset."""
    known = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder: for what a plan reads several times."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def counted(df: DataFrame, keys: list[str], value: str, name: str = "_c") -> DataFrame:
    """keys, ``value`` and how many rows have it: for values that repeat, what is left is a fraction of the rows."""
    return df.groupBy(*keys, value).agg(F.count("*").alias(name))


def quantiles(df: DataFrame, keys: list[str], value: str, times: str | None = None, **probs: float) -> DataFrame:
    """keys and one column for each name=probability: exact quantiles with linear interpolation, nulls left out; a row counts
    as many times as its column ``times`` says.

    One aggregation finds them for keys of up to ``SMALL`` rows.  Larger keys are spread over many tasks: equal values are
    counted, not sorted, and the counts are added up in two levels, over ranges of values that hold about equally many.
    """
    # keys as one struct: a null key is a key like others in every join
    known = cut(df.where(F.col(value).isNotNull()).select(F.struct(*keys).alias("_key"), F.col(value).alias("_v"), *([F.col(times).alias("_c")] if times else [])))
    rows = F.sum("_c") if times else F.count("*")
    counts = known.groupBy("_key").agg(rows.alias("_n"))
    names, wanted = list(probs), F.array(*[F.lit(p) for p in probs.values()])
    if (counts.agg(F.max("_n")).head()[0] or 0) <= SMALL:
        large, small = None, known
    else:
        large = cut(counts.where(F.col("_n") > SMALL))  # at most rows / SMALL
        small = known.join(_sent(large.select("_key")), "_key", "left_anti")
    q = small.groupBy("_key").agg((F.percentile("_v", wanted, F.col("_c")) if times else F.percentile("_v", wanted)).alias("_q")).select("_key", *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    q = q if large is None else q.unionByName(_large_quantiles(known, large, ["_key"], probs))
    return q.select("_key.*", *names)


def _sent(few: DataFrame) -> DataFrame:
    """``few``, a checkpoint, sent to all tasks if it has up to ``FEW`` rows."""
    return F.broadcast(few) if few.count() <= FEW else few


def _large_quantiles(known: DataFrame, large: DataFrame, keys: list[str], probs: dict[str, float], ranges: int = 64) -> DataFrame:
    """``quantiles`` of the keys in ``large`` (with their number of rows, _n)."""
    # equal values are one row from here on; no join or window sees all rows of a key
    values = cut(known.join(_sent(large.select(*keys)), keys, "left_semi").groupBy(*keys, "_v").agg((F.sum("_c") if "_c" in known.columns else F.count("*")).alias("_c")))
    cuts = values.groupBy(*keys).agg(F.percentile_approx("_v", [i / ranges for i in range(1, ranges)], 1000).alias("_cuts"))
    values = beside(beside(values, large, keys), cuts, keys)
    values = cut(values.select(*keys, "_n", "_v", "_c", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_b")))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = values.groupBy(*keys, "_b").agg(F.sum("_c").alias("_s")).select(*keys, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = values.join(starts, [*keys, "_b"]).withColumn("_upto", F.col("_start") + F.sum("_c").over(inside))  # rows up to and including the value

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_upto") - F.col("_c") <= place) & (place < F.col("_upto")), F.col("_v")))

    aggs = []
    for name, p in probs.items():
        place = F.lit(p) * (F.col("_n") - 1)
        low, high, share = at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))
        aggs.append((low + (high - low) * share).alias(name))
    return upto.groupBy(*keys).agg(*aggs)


def runs(df: DataFrame, keys: list[str], flag: str, ix: str = "ix") -> DataFrame:
    """keys, start, stop (exclusive), length of every maximal run of consecutive positions where ``flag`` is true.

    Runs are found block by block; the few that touch a block's ends are then joined over them.
    """
    on = df.where(F.col(flag)).select(*keys, F.col(ix).alias("_ix"), F.floor(F.col(ix) / BLOCK).alias("_blk"))
    grouped = on.withColumn("_g", F.col("_ix") - F.row_number().over(Window.partitionBy(*keys, "_blk").orderBy("_ix")))
    parts = cut(grouped.groupBy(*keys, "_blk", "_g").agg(F.min("_ix").alias("start"), (F.max("_ix") + 1).alias("stop")))
    at_end = (F.col("start") == F.col("_blk") * BLOCK) | (F.col("stop") == (F.col("_blk") + 1) * BLOCK)
    whole = _joined(parts.where(at_end), keys, F.lit(0)).select(*keys, "start", "stop")
    return parts.where(~at_end).select(*keys, "start", "stop").unionByName(whole).withColumn("length", F.col("stop") - F.col("start"))


def running_sum(df: DataFrame, keys: list[str], value: Column, name: str, ix: str = "ix") -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its keys up to and including its own, in two levels: blocks, then rows."""
    b = df.withColumn("_v", value).withColumn("_blk", F.floor(F.col(ix) / BLOCK))
    sums = b.groupBy(*keys, "_blk").agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "_blk", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_blk").orderBy(ix).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return b.join(starts, [*keys, "_blk"]).withColumn(name, F.col("_start") + F.sum("_v").over(inside)).drop("_v", "_blk", "_start")


def _joined(spans: DataFrame, keys: list[str], gap: Column, *sums: str) -> DataFrame:
    """Spans of a key (few) that lie no farther than ``gap`` apart made one, with the sums of ``sums``."""
    w = Window.partitionBy(*keys).orderBy("start")
    new = F.coalesce((F.col("start") - F.lag("stop").over(w) > gap).cast("int"), F.lit(1))
    grouped = spans.withColumn("_new", new).withColumn("_s", F.sum("_new").over(w))
    return grouped.groupBy(*keys, "_s").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), *[F.sum(c).alias(c) for c in sums]).drop("_s")


def merged(spans: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Spans closer than ``gap`` positions joined to one: keys, start, stop, parts.  Spans of a key mustn't overlap.

    Spans are joined block by block; the first and the last of each block are then joined over the blocks.
    """
    at = spans.select(*keys, "start", "stop", F.floor(F.col("start") / BLOCK).alias("_blk"))
    w = Window.partitionBy(*keys, "_blk").orderBy("start")
    new = F.coalesce((F.col("start") - F.lag("stop").over(w) >= gap).cast("int"), F.lit(1))
    grouped = at.withColumn("_new", new).withColumn("_g", F.sum("_new").over(w))
    parts = grouped.groupBy(*keys, "_blk", "_g").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("parts"))
    parts = cut(parts.withColumn("_last", F.max("_g").over(Window.partitionBy(*keys, "_blk"))))
    at_end = (F.col("_g") == 1) | (F.col("_g") == F.col("_last"))
    columns = [*keys, "start", "stop", "parts"]
    return parts.where(~at_end).select(*columns).unionByName(_joined(parts.where(at_end).select(*columns), keys, F.lit(gap - 1), "parts").select(*columns))
