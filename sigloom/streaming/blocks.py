"""Streaming forms: windows and sessions over event time, and state carried from batch to batch.

All run over a directory or file of events with the same code as over an endless source.  ``drained`` runs one over all of
a table: the events are dealt in order of time into files of bounded size, so that no row is late whatever files the
table has, and one event long after the last closes what is still open.
"""

from __future__ import annotations

import math
import posixpath
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sigloom.operators import kernels, layout

#: Events of a file that ``staged`` writes, files of a batch, and days after which a silent track is closed.
FILE_ROWS, BATCH_FILES, SILENT_DAYS = 1 << 20, 4, 365
#: The track and type of the closing event.
END_TRACK, END_TYPE = -(1 << 62), "end of input"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The events table as a stream, with ts as a timestamp."""
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"  # as a pattern the path may be one file as well as a directory
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", BATCH_FILES).parquet(pattern).withColumn("ts", F.col("ts").cast("timestamp"))


def staged(spark: SparkSession, path: str, folder: str, file_rows: int = FILE_ROWS) -> str:
    """The events at ``path`` written to ``folder`` in order of time, with the closing event last.  Null times are left out."""
    events = spark.read.parquet(path).where(F.col("ts").isNotNull())
    n, last = events.agg(F.count("*"), F.max("ts")).head()
    files = max(1, math.ceil(n / file_rows))
    events.repartitionByRange(files, "ts", "event_id").sortWithinPartitions("ts", "event_id").write.parquet(folder)
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted((f.getPath() for f in fs.listStatus(where) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    now = int(time.time() * 1000)
    for i, part in enumerate(parts):  # a file source reads in order of modification
        fs.setTimes(part, now - 1000 * (len(parts) + 10 - i), -1)
    if last is not None:
        end = {"ts": (F.lit(last) + F.expr(f"INTERVAL {2 * SILENT_DAYS} DAYS")), "user_id": F.lit(END_TRACK), "event_type": F.lit(END_TYPE)}
        spark.range(1).select(*[end.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema]).write.mode("append").parquet(folder)
    return folder


def run(stream: DataFrame, folder: str | None = None, mode: str = "append", whole: bool = False) -> DataFrame:
    """All that the stream gives for the input that is there now, as a table.

    ``folder`` holds the table and the state of the query; given again, the query goes on where it stopped and reads only
    what is new.  Without one, a new folder in the shared checkpoint folder is used.  ``whole`` raises where a row came too
    late for the watermark (in the batches whose progress Spark keeps), as it would be missing without a word.
    """
    spark = stream.sparkSession
    folder = folder or posixpath.join(layout.shared_folder(spark), f"stream-{uuid.uuid4().hex}")
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", posixpath.join(folder, "out")).option("checkpointLocation", posixpath.join(folder, "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    late = sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in p["stateOperators"])
    if whole and late:
        raise RuntimeError(f"{late} rows came later than the watermark: the store doesn't list files in the order in which they were set")
    return spark.read.schema(stream.schema).parquet(posixpath.join(folder, "out"))


def drained(spark: SparkSession, path: str, form: Callable[[DataFrame], DataFrame], file_rows: int = FILE_ROWS) -> DataFrame:
    """What ``form`` gives for all events at ``path``, windows and tails that are open at the end included."""
    folder = posixpath.join(layout.shared_folder(spark), f"stream-{uuid.uuid4().hex}")
    out = run(form(read_events(spark, staged(spark, path, posixpath.join(folder, "in"), file_rows))), folder, whole=True)
    kind = dict(out.dtypes)["track"]
    return out.where(~F.col("track").eqNullSafe(F.lit(END_TYPE if kind == "string" else END_TRACK)))


def tumbling(events: DataFrame, length: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """track, start, n, mean of closed windows; events later than ``late`` are left out."""
    w = events.withWatermark("ts", late).groupBy(F.col("event_type").alias("track"), F.window("ts", length).alias("w"))
    return w.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).select("track", F.col("w.start").alias("start"), "n", "mean")


def sliding(events: DataFrame, length: str = "15 hours", hop: str = "450 minutes", late: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.col("event_type").alias("track"), F.window("ts", length, hop).alias("w"))
    return w.agg(F.count("*").alias("n"), F.round(F.max("value"), 6).alias("top")).select("track", F.col("w.start").alias("start"), "n", "top")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return w.agg(F.count("*").alias("n")).select(F.col("user_id").alias("track"), F.col("w.start").alias("start"), "n")


def filtered(events: DataFrame, cutoff: float = 0.05) -> DataFrame:
    """event_id, track, y: each track high-passed in order of (ts, event_id), the filter's state carried from batch to batch.

    Batches must come in order of time, as ``staged`` or a partitioned log gives them; a batch is as large as its files.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        y, after = kernels.high_pass(df["value"].to_numpy(float), cutoff, state.get if state.exists else (0.0, 0.0, 0.0, 0.0))
        state.update(after)
        yield pd.DataFrame({"event_id": df["event_id"], "track": key[0], "y": y})

    return events.groupBy("user_id").applyInPandasWithState(step, "event_id long, track long, y double", "x1 double, x2 double, y1 double, y2 double", "append", GroupStateTimeout.NoTimeout)


def overlap_added(events: DataFrame, frame: int = 8, late: str = "1 hour") -> DataFrame:
    """track, ix, y: windowed synthesis with hops of half a frame; the tail and the unfinished samples are the state.

    Each frame is weighted by a square-root Hann window twice, so that frames add up to the signal; the first half
    frame, which only one frame covers, comes out faded in.  A track that is silent for ``SILENT_DAYS`` is closed: what is
    unfinished is padded with zeros and comes out; should it be heard again, it fades in anew at the next position.
    """
    hop = frame // 2
    window = np.sin(np.pi * (np.arange(frame) + 0.5) / frame) ** 2

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        carry, tail, done = state.get if state.exists else ([], [0.0] * hop, 0)
        tail, out, at = np.array(tail), [], 0
        if state.hasTimedOut:
            x, upto = np.concatenate([carry, np.zeros(frame)]), len(carry)
        else:
            df = pd.concat(list(parts)).sort_values(["ts", "event_id"])
            x = np.concatenate([carry, df["value"].to_numpy(float)])
            upto = len(x) - frame + 1
        while at < upto:
            y = x[at : at + frame] * window
            out.append(y[:hop] + tail)
            tail, at = y[hop:], at + hop
        flat = np.concatenate(out) if out else np.zeros(0)
        if state.hasTimedOut:
            flat = flat[:upto]
            state.update(([], [0.0] * hop, done + len(flat)))  # where the track goes on if it is heard again
        else:
            state.update((x[at:].tolist(), tail.tolist(), done + len(flat)))
            state.setTimeoutTimestamp(int(df["ts"].max().timestamp() * 1000) + SILENT_DAYS * 86_400_000)
        yield pd.DataFrame({"track": key[0], "ix": done + np.arange(len(flat)), "y": flat})

    timed = events.withWatermark("ts", late)
    return timed.groupBy("user_id").applyInPandasWithState(step, "track long, ix long, y double", "carry array<double>, tail array<double>, done long", "append", GroupStateTimeout.EventTimeTimeout)
