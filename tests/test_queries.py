"""Every query of the catalogue against its SQL on the smallest set."""

import os

import duckdb
import pytest

from glossa.functions import inline
from glossa.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "documents events labels conversations pages"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES.split():
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def compare(spark, duck, query, sql):
    df = query(spark, DATA)
    got = duck.sql(sql)
    assert sorted(df.columns) == sorted(got.columns)
    columns, at = sorted(df.columns), [got.columns.index(c) for c in sorted(df.columns)]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    ours = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    theirs = sorted((tuple(r[i] for i in at) for r in got.fetchall()), key=key)
    assert ours == theirs


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, duck, name):
    compare(spark, duck, catalogue.QUERIES[name], catalogue.SQL[name])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_html_tag_quality(spark):
    """The query without SQL, page by page: well-formed tags need back-references."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    want = {}
    for p in pages:
        n, wrong = inline.compliance(p.html or "", 2)
        want[p.page_id] = (n, len(wrong), round(1.0 if n + len(wrong) == 0 else n / (n + len(wrong) / 2), 6))
    assert {r.page_id: (r.correct, r.wrong, r.quality) for r in catalogue.QUERIES["html_tag_quality"](spark, DATA).collect()} == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
