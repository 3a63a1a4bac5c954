"""Registration of queries and of their DuckDB equivalents."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from queuelens.catalog.views import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None, views: tuple[str, ...] = (), recursive: bool = False):
    """Register ``fn(spark, folder)`` under ``key``, with its SQL if it has one."""

    def add(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")

        @functools.wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")  # fixture times are UTC
            return fn(spark, folder)

        QUERIES[key] = run
        if sql is not None:
            SQL[key] = with_views(sql, *views, recursive=recursive)
        return fn

    return add
