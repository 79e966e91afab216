"""Registration of queries and of the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .views import VIEW_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Register a function under its name; ``sql`` may read the named input views."""
    def register(function):
        name = function.__name__
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = with_views(sql, *views)
        return function

    return register


def with_views(sql: str, *views: str) -> str:
    if not views:
        return sql
    texts = [f"{name} AS ({VIEW_SQL[name]})" for name in views]
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return "WITH " + ", ".join(texts) + ", " + body[5:]
    return "WITH " + ", ".join(texts) + " " + body


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Round floating sums, whose last digits depend on the order of addition."""
    return df.withColumns({c: F.round(c, places) for c in columns})
