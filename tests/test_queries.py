"""Every query of the core runs; those with SQL give the same rows as DuckDB. The core stands without the subpackage llm."""

import datetime as dt
import decimal
import glob
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from almanak.plans import catalog

ROOT = Path(__file__).resolve().parents[1]


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, duck, name):
    df = catalog.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in catalog.ORACLE:
        result = duck.execute(catalog.ORACLE[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        assert sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr) == rows


def test_entry(spark, data):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_imports_nothing_of_llm():
    code = "import sys; sys.modules['almanak.llm'] = None; import __spark_entry__ as e; assert e.llm_catalog is None and len(e.queries()) > 40"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, timeout=120).returncode == 0
    for p in (ROOT / "almanak").rglob("*.py"):
        if "llm" not in p.parts:
            assert "almanak.llm" not in p.read_text(), p
