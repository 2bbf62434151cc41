"""The registry of queries: each has a key, a Spark plan and, where SQL can express it, oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _with_views(sql: str) -> str:
    for head in ("WITH RECURSIVE ", "WITH "):
        if sql.startswith(head):
            return head + SQL.removeprefix("WITH ") + ", " + sql.removeprefix(head)
    return SQL + sql


def query(key: str, sql: str | None = None, views: bool = True) -> Callable[[Query], Query]:
    """Register a query; its SQL may use the views executions, ev, attempts, items and runs."""

    def add(f: Query) -> Query:
        QUERIES[key] = f
        if sql:
            ORACLES[key] = _with_views(sql.strip()) if views else sql.strip()
        return f

    return add
