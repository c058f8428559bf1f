"""Every core query against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from strataloom.plans import catalogue

ROOT = os.environ.get("STRATALOOM_TESTDATA", "/root/testdata/sf0.001")
QUERIES, ORACLES = catalogue.queries(), catalogue.oracles()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(ROOT):
        con.execute(f"create view {name.split('.')[0]} as select * from '{ROOT}/{name}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    try:
        f = float(v)
    except (TypeError, ValueError):
        return str(v)
    return "nan" if math.isnan(f) else repr(round(f, 5) + 0.0)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sql, name):
    df = QUERIES[name](spark, ROOT)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*columns).collect())
    answer = sql.execute(ORACLES[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in answer.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, ROOT).count() >= 0


def test_no_key_without_query():
    assert set(ORACLES) <= set(QUERIES)
