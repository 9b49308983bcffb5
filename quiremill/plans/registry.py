"""Named queries: a Spark plan over the given tables and, where one exists, the DuckDB statement it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .sqlviews import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: dict[str, str] | None = None, like: str | None = None):
    """`like`: the query whose statement holds for this one too."""
    def add(fn):
        QUERIES[name] = fn
        if like is not None:
            ORACLES[name] = ORACLES[like]
        if sql is not None:
            ORACLES[name] = with_views(sql, views)
        return fn
    return add
