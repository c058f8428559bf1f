"""Queries of the subpackage against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from strataloom.llm import queries

ROOT = os.environ.get("STRATALOOM_TESTDATA", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for file in os.listdir(ROOT):
        con.execute(f"create view {file.split('.')[0]} as select * from '{ROOT}/{file}'")
    df = queries.QUERIES[name](spark, ROOT)
    columns = sorted(df.columns)
    got = sorted(tuple(map(str, r)) for r in df.select(*columns).collect())
    answer = con.execute(queries.ORACLES[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(str(r[names.index(c)]) for c in columns) for r in answer.fetchall())
