"""Exact duplicates by tree-merge, against a dictionary of texts."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from sigloom.llm import exact_dedup

SCHEMA = "doc_id long, text string, keep_id string, node int"


def by_hand(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    out = []
    for d, t in rows:
        ids = groups[t or ""]
        known = [i for i in ids if i is not None]
        out.append((d, max(known) if known else None, len(ids), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str), len(groups)


@pytest.mark.parametrize("fan_in, parts", [(2, 7), (2, 1), (3, 9), (16, 40)])
def test_against_a_dictionary(spark, fan_in, parts):
    pick = random.Random(fan_in * parts)
    rows = [(i, pick.choice(["", None, "same", "a", "a ", "A", "é", "é"]) if i % 3 else "hot") for i in range(300)]
    rows += [(1000 + i, f"own {i}") for i in range(50)] + [(None, "hot"), (None, "lone"), (None, "lone"), (5, "own 5"), (7, "hot")]
    rows += [(2000, "long " * 100_000 + " ".join(map(str, range(50_000))))] * 2
    docs = spark.createDataFrame([(d, t, "clash", 9) for d, t in rows], SCHEMA).repartition(parts)
    got = exact_dedup.duplicates(docs, fan_in=fan_in).collect()
    want, n_groups = by_hand(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == n_groups == len({r.text_sha256 for r in kept})  # one a group, of rows that repeat an id and text too
    assert all(r.doc_id == r.keep_id for r in kept)


def test_empty_table(spark):
    assert exact_dedup.duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_false_digest_ends_the_query(spark):
    runs = spark.createDataFrame([(0, b"d", 1, 1, 5), (1, b"d", 2, 1, 6)], "node long, digest binary, id long, n long, p long")
    runs = runs.select("node", "digest", F.struct("id").alias("best"), "n", F.struct("p").alias("proof"))
    with pytest.raises(Exception, match="different texts share a digest"):
        exact_dedup._merged(runs, F.lit(0)).collect()


def test_main_path_is_native(spark):
    import inspect

    code = inspect.getsource(exact_dedup)
    assert not any(w in code for w in ("udf", "pandas", "pyarrow", ".rdd", "applyIn", "mapIn"))
