"""Named queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from storyloom.sources.lens import oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; its SQL names model tables in braces."""

    def put(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = oracle(sql)
        return run

    return put
