"""Every query of the subpackage runs; those with SQL give the same rows as DuckDB."""

import glob
import os

import duckdb
import pytest

from almanak.llm import catalog, encode

pytestmark = pytest.mark.skipif(not os.path.exists(encode.TOKENIZERS), reason="no tokenizers here")


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, name):
    df = catalog.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in catalog.ORACLE:
        con = duckdb.connect()
        for p in glob.glob(f"{data}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
        result = con.execute(catalog.ORACLE[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        assert sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr) == rows
