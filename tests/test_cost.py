"""Bytes that queries move between tasks for each line item: tracks move as arrays, and are numbered once."""

import pytest
import __spark_entry__

D = "/root/testdata/sf0.01"


def written(spark) -> int:
    context = spark.sparkContext
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize(("name", "most"), [("plosive_tame", 90), ("sibilant_guard", 100), ("loudness_stage", 45), ("file_readings", 80), ("channel_lag", 80)])
def test_bytes_moved_a_row(spark, name, most):
    rows, before = spark.read.parquet(f"{D}/lineitem.parquet").count(), written(spark)
    __spark_entry__.queries()[name](spark, D).collect()
    assert written(spark) - before <= most * rows
