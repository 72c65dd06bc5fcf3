"""Named queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(made: Query) -> Query:
        QUERIES[name] = made
        if sql is not None:
            SQL[name] = sql
        return made

    return add


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Named columns rounded, so that summation order does not show."""
    return df.withColumns({n: F.round(F.col(n).cast("double"), digits) for n in names})


def r(c: Column, digits: int = 6) -> Column:
    return F.round(c.cast("double"), digits)
