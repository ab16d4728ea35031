"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import BATCH, CLEANUP, if_small, new_path, shared_dir, sliced, slices, staged, staged_parts, unstage

__all__ = ["BATCH", "CLEANUP", "ascii_lower", "heavy_join", "if_small", "let", "new_path", "shared_dir", "sliced", "slices", "staged", "staged_parts", "table", "unstage", "words"]

WHITESPACE = "\t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    The optimizer may inline a projected column into a lambda, where it would be
    evaluated again for every element; a lambda variable cannot be inlined.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, UPPER.lower())


def words(c: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.translate(F.coalesce(c, F.lit("")), WHITESPACE, " " * 5), " "), "")


def heavy_join(left: DataFrame, right: DataFrame, key: str, share: int = 256) -> DataFrame:
    """Left join of a staged table with one row of ``right`` for each key, safe from heavy keys.

    Fewer than ``share`` keys can each hold more than 1/share of the rows. Their rows of
    ``right``, so bounded, are broadcast; all other keys are light and join by a shuffle.
    """
    rows = left.count()
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    heavy = [r[0] for r in counts.where(F.col("n") > rows / share).select(key).collect()]
    if not heavy:
        return left.join(right, key, "left")
    hot = F.coalesce(F.col(key).isin(heavy), F.lit(False))
    return left.where(hot).join(F.broadcast(right.where(hot)), key, "left").unionByName(left.where(~hot).join(right.where(~hot), key, "left"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
