"""Where the registered queries and their SQL twins are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL_TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL twin if SQL can express it."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL_TWINS[name] = sql
        return fn

    return add


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    """Round the named doubles for a comparison across engines."""
    return df.withColumns({c: F.round(F.col(c), places) for c in columns})


def big(col: Column) -> Column:
    return col.cast("bigint")
