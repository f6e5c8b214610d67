"""Append-only records with unique ids, and validation as rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "id string, date string, round string, tape string, question struct<type: string, stimuli: array<string>, blind: boolean, text: string>, answer string, n_trials long, n_correct long, confidence double"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Verdict records of JSON lines; a line that is no record keeps its text in _corrupt."""
    return spark.read.schema(LEDGER + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def problems(ledger: DataFrame) -> DataFrame:
    """id, problem: one row for everything wrong with a record."""
    checks = [
        ("corrupt line", F.col("_corrupt").isNotNull()),
        ("no id", F.col("id").isNull() & F.col("_corrupt").isNull()),
        ("bad date", F.col("date").isNotNull() & F.try_to_date("date", "yyyy-MM-dd").isNull()),
        ("unknown question", F.col("question.type").isNotNull() & ~F.col("question.type").isin("abx", "pair", "blend", "flag", "preference")),
        ("more right than trials", F.col("n_correct") > F.col("n_trials")),
        ("confidence out of range", ~F.col("confidence").between(0, 1)),
    ]
    found = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks]))
    return ledger.select("id", F.explode(found).alias("problem"))


def append_new(fresh: DataFrame, path: str, key: str = "id") -> int:
    """Append rows whose key is not there yet (of repeats within ``fresh`` the first by all columns) as JSON lines; how many."""
    spark = fresh.sparkSession
    try:
        there = spark.read.json(path).select(key)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        there = fresh.select(key).limit(0)
    new = fresh.dropDuplicates([key]).join(there, key, "left_anti").persist()
    n = new.count()
    if n:
        new.select(*fresh.columns).write.mode("append").json(path)
    new.unpersist()
    return n
