"""Every query with SQL gives the rows that DuckDB gives on the smallest tables."""

import importlib.util
import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from strandframe.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = Path(__file__).resolve().parents[1]


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v + 0.0:.5f}"
    return str(v)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    at = [want.columns.index(c) for c in order]
    rows = lambda data, pick: sorted(tuple(norm(pick(r, i)) for i in range(len(order))) for r in data)
    assert rows(got.select(order).collect(), lambda r, i: r[i]) == rows(want.fetchall(), lambda r, i: r[at[i]])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    df = registry.queries()[name](spark, SF)
    assert df.columns and df.collect()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_optional_subpackage(tmp_path):
    for p in ROOT.glob("*.py"):
        if p.name != "corpus_pipeline.py":
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "strandframe").mkdir()
    for p in (ROOT / "strandframe").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "strandframe" / p.name).symlink_to(p)
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') for q in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
    assert said.stdout.split() == [str(len(registry.queries())), "False"], said.stderr


def test_nothing_else_imports_the_optional_subpackage():
    for p in (ROOT / "strandframe").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "strandframe.llm" not in p.read_text(), p
    assert importlib.util.find_spec("strandframe") is not None
