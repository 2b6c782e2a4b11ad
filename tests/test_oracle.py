"""Every core query against its SQL on the smallest tables, as far as DuckDB and the tables are there."""

import importlib
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
PLANS = ("general", "retrieval", "evaluation", "words", "ranking", "facets", "entities", "scans", "streams", "chat")
CASES = [(p, q) for p in PLANS for q in importlib.import_module(f"cellarflow.plans.{p}").SQL]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for file in os.listdir(DATA):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{DATA}/{file}'")
    return con


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-5 * max(1.0, abs(a)))


@pytest.mark.parametrize(("plan", "query"), CASES)
def test_query(spark, duck, plan, query):
    module = importlib.import_module(f"cellarflow.plans.{plan}")
    df = module.QUERIES[query](spark, DATA)
    cursor = duck.execute(module.SQL[query])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = [tuple(plain(v) for v in row) for row in duck.execute(f"select {', '.join(chr(34) + c + chr(34) for c in sorted(names))} from ({module.SQL[query]})").fetchall()]
    got = [tuple(plain(row[c]) for c in sorted(names)) for row in df.collect()]
    order = lambda row: [(v is None, isinstance(v, str), round(v, 3) if isinstance(v, float) else v if v is not None else 0) if not isinstance(v, bool) else (False, False, float(v)) for v in row]
    got, want = sorted(got, key=order), sorted(want, key=order)
    assert len(got) == len(want)
    assert all(all(map(same, g, w)) for g, w in zip(got, want))
