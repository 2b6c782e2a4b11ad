"""The queries that SQL can express, against DuckDB on the smallest tables."""

import os

import pytest

from cellarflow.llm.queries import QUERIES, SQL

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("query", list(SQL))
def test_query(spark, query):
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{DATA}/{file}'")
    df = QUERIES[query](spark, DATA)
    columns = sorted(df.columns)
    want = con.execute(f"select {', '.join(columns)} from ({SQL[query]})").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(want, key=str)
