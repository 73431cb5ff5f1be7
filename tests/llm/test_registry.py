"""Every registered query with SQL against it, on the smallest set."""

import os

import duckdb
import pytest

from glossa.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        duck.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df, got = queries.QUERIES[name](spark, DATA), duck.sql(queries.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(got.columns)
    key = lambda row: tuple(map(str, row))
    at = [got.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key) == sorted((tuple(r[i] for i in at) for r in got.fetchall()), key=key)


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
