"""The registered queries over the small tables; those with SQL against DuckDB."""

import glob
import os

import pytest

from prosarium.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no test data here")
    df = queries.QUERIES[name](spark, DATA)
    got = sorted(map(tuple, df.collect()), key=str)
    assert got
    if name in queries.SQL:
        import duckdb

        con = duckdb.connect()
        for p in glob.glob(f"{DATA}/*.parquet"):
            con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
        rel = con.sql(queries.SQL[name])
        assert rel.columns == df.columns and got == sorted(rel.fetchall(), key=str)
