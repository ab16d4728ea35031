"""Registry of named queries and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, ctes: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL over the common table expressions."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = ("WITH RECURSIVE " + ",\n".join(ctes) + "\n" if ctes else "") + sql
        return f

    return register


def ts(literal: str) -> Column:
    return F.expr(f"timestamp_ntz'{literal}'")


def text(c: str) -> Column:
    """A timestamp as text to the second."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
