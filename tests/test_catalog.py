"""Every registered query against its DuckDB twin, and the entry points with and without the corpus subpackage."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from tidewright import catalog
from tidewright.session import TABLES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _rows(columns, rows):
    text = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    assert len(set(df.columns)) == len(df.columns)
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    assert _rows(df.columns, rows) == _rows(want.columns, want.fetchall())


def test_oracles_name_queries():
    assert catalog.ORACLE_SQL.keys() <= catalog.QUERIES.keys()


def test_entry_points_without_the_corpus_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", ".pytest_cache", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'visibility_edges' in q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; assert e.oracle_sql(); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(copy)})
    assert done.returncode == 0, done.stderr
