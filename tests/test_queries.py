"""Every registered query of the library against its SQL in DuckDB."""

import math

import duckdb
import pytest
from sigloom import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(names, data):
    """Rows with columns in order of name, sorted by what isn't a fraction first."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    picked = [tuple(r[i] for i in order) for r in data]
    return sorted(picked, key=lambda r: ([str(v) for v in r if not isinstance(v, float)], [round(v, 4) for v in r if isinstance(v, float)]))


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return (math.isnan(a) and math.isnan(b)) or math.isclose(a, b, rel_tol=1e-7, abs_tol=2e-8)
    return a == b


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, sf, duck, name):
    got, want = catalog.QUERIES[name](spark, sf), duck.sql(catalog.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    left, right = rows(got.columns, got.collect()), rows(want.columns, want.fetchall())
    assert len(left) == len(right)
    assert [(a, b) for a, b in zip(left, right) if not all(map(same, a, b))] == []


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 2
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) == len(set(e.queries()))


def test_works_without_the_corpus_operators(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "sigloom"), tmp_path / "sigloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'trade_readings' in q and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
