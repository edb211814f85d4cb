"""The registry of named queries and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from starling.sources.views import SQL_ORDER_REVIEWS, SQL_REVIEWS, sql_bucket

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name; ``sql`` may use the views order_reviews, reviews, folded and lines."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return register


def with_views(sql: str) -> str:
    views = [SQL_ORDER_REVIEWS, SQL_REVIEWS]
    views.append(f"folded AS (SELECT *, {sql_bucket('id', 5)} AS fold, {sql_bucket('id', 5, 'split')} = 4 AS scoring FROM order_reviews)")
    views.append(f"lines AS (SELECT *, {sql_bucket('id', 5)} AS fold FROM reviews)")
    sql = sql.strip()
    if sql.startswith("WITH "):
        return "WITH " + ", ".join(views) + ", " + sql[5:]
    return "WITH " + ", ".join(views) + " " + sql
