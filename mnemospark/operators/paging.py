"""Keyset and offset pages.

A keyset page reads forward from the sort key of the last row seen: the predicate is the
lexicographic one, whatever the directions, so no row is repeated or missed. The sort and
limit run as one top-k over the partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def after(order: list[tuple[str, bool]], last: list[object]) -> Column:
    """Rows behind ``last`` in the order of (column, ascending) pairs."""
    out = F.lit(False)
    equal = F.lit(True)
    for (name, ascending), value in zip(order, last, strict=True):
        v = value if isinstance(value, Column) else F.lit(value)
        out = out | (equal & ((F.col(name) > v) if ascending else (F.col(name) < v)))
        equal = equal & (F.col(name) == v)
    return out


def keyset_page(df: DataFrame, order: list[tuple[str, bool]], limit: int, last: list[object] | None = None, ceiling: int = 500) -> DataFrame:
    """The next ``limit`` rows, and has_more in each of them."""
    n = max(1, min(limit, ceiling))
    rows = df if last is None else df.where(after(order, last))
    sort = [F.col(c).asc() if up else F.col(c).desc() for c, up in order]
    probe = rows.orderBy(*sort).limit(n + 1)  # one more tells whether there are others
    more = probe.agg((F.count(F.lit(1)) > n).alias("has_more"))
    return probe.orderBy(*sort).limit(n).crossJoin(more)  # one row


def offset_page(df: DataFrame, sort: list[Column], page: int, size: int, ceiling: int = 200) -> DataFrame:
    n = max(1, min(size, ceiling))
    return df.orderBy(*sort).offset((max(1, page) - 1) * n).limit(n)


def recent_history(episodes: DataFrame, exclude: object, n: int = 10) -> DataFrame:
    """The newest n episodes but one, oldest of them first."""
    return episodes.where(F.col("id") != exclude).orderBy(F.desc("created_at"), F.desc("id")).limit(n).orderBy("created_at", "id")


def stale_sessions(sessions: DataFrame, before: Column, limit: int = 100) -> DataFrame:
    return sessions.where(F.col("closed_at").isNull() & (F.col("updated_at") < before)).orderBy("updated_at", "id").limit(limit)


def audit_page(logs: DataFrame, equal: dict[str, object], json_int: tuple[str, str, int] | None = None, not_prefixes: tuple[str, ...] = (), since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Audit filter: equalities, a JSON integer, no excluded prefix of action, an inclusive time range."""
    for name, value in equal.items():
        logs = logs.where(F.col(name) == value)
    if json_int:
        column, path, value = json_int
        logs = logs.where(F.try_variant_get(F.try_parse_json(column), path, "int") == value)
    for prefix in not_prefixes:
        logs = logs.where(~F.col("action").startswith(prefix))
    if since is not None:
        logs = logs.where(F.col("created_at") >= since)
    return logs if until is None else logs.where(F.col("created_at") <= until)


def search_text(df: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Case-insensitive substring in any column; LIKE signs in the query are plain characters."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(query.lower())), F.lit(False))
    return df.where(hit)


def created_between(df: DataFrame, column: str, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Rows of the half-open range [start, end); a missing bound is open."""
    out = df if start is None else df.where(F.col(column) >= start)
    return out if end is None else out.where(F.col(column) < end)


def list_schemas(schemas: DataFrame, schema_type: object = None, active: bool | None = None) -> DataFrame:
    """Extraction schemas, newest first, of a type and state where these are given."""
    out = schemas if schema_type is None else schemas.where(F.col("type") == schema_type)
    out = out if active is None else out.where(F.col("is_active") == active)
    return out.orderBy(F.desc("created_at"), "id")
