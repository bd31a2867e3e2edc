"""Registration of queries and the views they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a Spark query and, where SQL can say it, its twin. The SQL may
    name the fixture views like tables."""

    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = fn
        if sql is not None:
            from lodestead.queries import views

            ORACLES[name] = views.with_views(sql)
        return fn

    return add
