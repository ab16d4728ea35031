"""Column expressions of the bitemporal model.

A fact is valid on the half-open interval [valid_from, valid_to) and visible until its
hard retraction at invalid_at; a null bound is open. Edges close their upper bound.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def effective_at(t: Column, upper_inclusive: bool = False, invalid_at: str = "invalid_at", valid_from: str = "valid_from", valid_to: str = "valid_to") -> Column:
    """True where a row is visible at ``t``."""
    invalid, start, end = F.col(invalid_at), F.col(valid_from), F.col(valid_to)
    before_end = end >= t if upper_inclusive else end > t
    return (invalid.isNull() | (invalid > t)) & (start.isNull() | (start <= t)) & (end.isNull() | before_end)


def effective_in(start: Column, end: Column) -> Column:
    """True where validity overlaps [start, end)."""
    return (F.col("invalid_at").isNull() | (F.col("invalid_at") > start)) & (F.col("valid_from").isNull() | (F.col("valid_from") < end)) & (F.col("valid_to").isNull() | (F.col("valid_to") > start))


def overlaps(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    """Half-open intervals with open null bounds overlap; adjacent ones do not."""
    return (a_from.isNull() | b_to.isNull() | (a_from < b_to)) & (b_from.isNull() | a_to.isNull() | (b_from < a_to))


def born_dead(valid_from: Column | str = "valid_from", valid_to: Column | str = "valid_to") -> Column:
    """A range that no instant satisfies."""
    return F.coalesce(_col(valid_from) >= _col(valid_to), F.lit(False))


def parse_instant(c: Column) -> Column:
    """ISO-8601 text, a trailing Z allowed; unreadable text is null."""
    return F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00"))


def validity_suffix(valid_from: Column, valid_to: Column) -> Column:
    """`` (valid: a to b)`` with the bounds there are; empty without any."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return (
        F.when(valid_from.isNotNull() & valid_to.isNotNull(), F.concat(F.lit(" (valid: "), day(valid_from), F.lit(" to "), day(valid_to), F.lit(")")))
        .when(valid_from.isNotNull(), F.concat(F.lit(" (valid: from "), day(valid_from), F.lit(")")))
        .when(valid_to.isNotNull(), F.concat(F.lit(" (valid: until "), day(valid_to), F.lit(")")))
        .otherwise("")
    )


def hours_between(earlier: Column, later: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 3_600_000_000
