"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import math
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of a text, in Java's, Python's and RE2's regular expressions alike.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that go to a Python worker at a time: texts are long, and ids longer.
TEXTS_A_BATCH = "2000"


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors (once per Spark context), and batches to Python workers fit for texts.

    The batch size is changed only where the session has Spark's default of 10,000 rows.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXTS_A_BATCH)
    root = Path(__file__).resolve().parents[2]
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if any(p and Path(p).resolve() == root for p in known) or getattr(spark.sparkContext, "_sigloom_shipped", False):
        return
    path = Path(tempfile.mkdtemp()) / "sigloom_pkg.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((root / "sigloom").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(path))
    spark.sparkContext._sigloom_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, which the cluster names in ``spark.checkpoint.dir``.

    Only a local session, where both are one machine, may leave it unset: it gets a temporary folder.
    """
    known = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this session wrote, wherever Spark can write."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, so that a lost executor costs no recomputation.

    The folder is that of ``shared_folder``.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def swept(df: DataFrame) -> DataFrame:
    """``cut``, and the files of shuffles and checkpoints that nothing uses any more go: Spark deletes them when the driver
    collects its garbage, which with much memory and long jobs may be never."""
    out = cut(df)
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return out


def in_fold(doc_id: Column | str, parts: int, part: int) -> Column:
    """True where crc32 of the id written as text leaves ``part`` when divided by ``parts``; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % parts == part, F.lit(False))


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, keep: Column, per_class: dict[int, int]) -> DataFrame:
    """A bounded sample of labelled texts: text, label, weight.

    ``per_class`` bounds the rows of each label value (met in expectation: rows are kept by a hash of their id, so that
    the choice is the same in every run and takes no sort).  The weight is how many labelled rows a sampled one stands
    for.  A document labelled twice counts with its larger label, one that is there twice with its least text; null
    texts, ids and labels, and labels without a bound, take no part.
    """
    lab = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(*per_class)).where(keep).groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    sizes = {r["_label"]: r["n"] for r in lab.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    share = {k: min(1.0, per_class[k] / n) for k, n in sizes.items() if n}
    pick, weight = F.lit(False), F.lit(1.0)
    for k, s in sorted(share.items()):
        pick = pick | ((F.col("_label") == k) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < math.ceil(s * (1 << 20))))
        weight = F.when(F.col("_label") == k, 1.0 / s).otherwise(weight)
    chosen = F.broadcast(lab.where(pick))  # at most the rows that per_class allows, whatever the size of the tables
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(chosen, "doc_id").groupBy("doc_id", "_label").agg(F.min("text").alias("text"))
    return rows.select("text", F.col("_label").alias("label"), weight.alias("weight"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, per_class: dict[int, int]) -> list[tuple[str, int, float]]:
    """The rows of ``labelled_rows`` on the driver, whole texts: for short ones."""
    return sorted(map(tuple, labelled_rows(docs, labels, label, keep, per_class).collect()))
