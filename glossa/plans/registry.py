"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glossa.plans import derived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, spans: bool = True):
    """Registers a query under its function's name; spans: the SQL builds on the derived spans."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (derived.SQL + "," + sql.strip()[4:]) if spans and sql.strip().startswith("WITH") else (derived.SQL + sql) if spans else sql
        return f

    return add
