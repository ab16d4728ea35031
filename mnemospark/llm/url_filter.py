"""URL filter: host and path rules, then logistic regression on hashed character n-grams.

The regression is trained from a small labelled URL table (url, blocked), a parameter;
:func:`labelled` gives the one that comes with the library. Everything that touches the
rows is a column expression. Only the fit leaves Spark: it works on at most ``max_rows``
URLs on the driver.

Defined results: a null URL, or one without ``://``, has an empty host and path and is
judged by the model's intercept; repeated rows are judged alike; an empty table gives an
empty result; extra columns are kept by :func:`judge`, whose own columns replace columns
of the same names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import url_labels
from .common import ascii_lower, let


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a host, with all its subdomains, and the start of a path."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.split("/", 1)[0]

    @property
    def path(self) -> str:
        return self.pattern[len(self.host) :]


@dataclass(frozen=True)
class UrlModel:
    """Weights of hashed n-grams, the intercept last."""

    weights: tuple[float, ...]
    sizes: tuple[int, ...] = (3, 4)

    @property
    def buckets(self) -> int:
        return len(self.weights) - 1


def host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_of(rules: list[Rule], host_col: Column, path_col: Column) -> Column:
    """Pattern of the longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.pattern)):
        fits = ((host_col == r.host) | host_col.endswith("." + r.host)) & path_col.startswith(r.path)
        out = F.when(fits, F.lit(r.pattern)).otherwise(out)
    return out


def ngram_buckets(host_col: Column, path_col: Column, sizes: tuple[int, ...], buckets: int) -> Column:
    """Distinct buckets of the character n-grams of ``^host$`` and ``^path$``."""

    def of(text: Column, tag: str) -> Column:
        def sized(chars: Column, size: int) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(chars) - size + 1))
            return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(tag), F.lit(size), F.slice(chars, i, size)), F.lit(buckets)).cast("int"))

        chars = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")
        return let(chars, lambda c: F.concat(*[sized(c, size) for size in sizes]))

    return F.array_distinct(F.concat(of(host_col, "host"), of(path_col, "path")))


def fit(labelled: DataFrame, buckets: int = 4096, sizes: tuple[int, ...] = (3, 4), max_rows: int = 2000, steps: int = 300, rate: float = 1.0, ridge: float = 1e-3) -> UrlModel:
    """Fit on ``labelled`` (url, blocked boolean).

    At most ``max_rows`` rows enter, those with the smallest hashes of their URL, so the
    table that the driver holds is bounded. With no row, or one class only, the model is
    an intercept.
    """
    rows = (
        labelled.where(F.col("url").isNotNull() & F.col("blocked").isNotNull())
        .groupBy("url")
        .agg(F.max("blocked").alias("blocked"))
        .orderBy(F.xxhash64("url"), "url")
        .limit(max_rows)
        .select(ngram_buckets(host(F.col("url")), path(F.col("url")), sizes, buckets).alias("x"), "blocked")
        .collect()
    )
    y = np.array([float(r["blocked"]) for r in rows])
    weights = np.zeros(buckets + 1)
    if len(set(y)) < 2:
        weights[-1] = (4.0 if y[0] else -4.0) if len(y) else -4.0
        return UrlModel(tuple(weights), sizes)
    row = np.repeat(np.arange(len(rows)), [len(r["x"]) for r in rows])
    col = np.concatenate([np.array(r["x"]) for r in rows])
    scale = 1 / np.sqrt(np.bincount(row, minlength=len(rows)))
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    for _ in range(steps):
        z = np.bincount(row, weights[col], len(rows)) * scale + weights[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
        weights[:-1] -= rate * 10 * (np.bincount(col, (error * scale)[row], buckets) + ridge * weights[:-1])
        weights[-1] -= rate * error.sum()
    return UrlModel(tuple(float(w) for w in weights), sizes)


def probability(model: UrlModel, host_col: Column, path_col: Column) -> Column:
    """Probability that a URL is to be blocked."""
    weights = F.lit(np.array(model.weights[:-1]))

    def score(x: Column) -> Column:
        total = F.aggregate(x, F.lit(0.0), lambda s, i: s + F.element_at(weights, i + 1))
        return total / F.sqrt(F.size(x)) + F.lit(model.weights[-1])

    return 1 / (1 + F.exp(-let(ngram_buckets(host_col, path_col, model.sizes, model.buckets), score)))


def judge(pages: DataFrame, rules: list[Rule], model: UrlModel, threshold: float = 0.5) -> DataFrame:
    """Add host, path, rule, block_probability and verdict to every row."""
    verdict = F.lit(None).cast("string")
    for r in rules:
        verdict = F.when(F.col("rule") == r.pattern, F.lit(r.verdict)).otherwise(verdict)
    return (
        pages.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
        .withColumn("rule", rule_of(rules, F.col("host"), F.col("path")))
        .withColumn("block_probability", probability(model, F.col("host"), F.col("path")))
        .withColumn("verdict", F.coalesce(verdict, F.when(F.col("block_probability") >= threshold, "block").otherwise("allow")))
    )


def labelled(spark: SparkSession) -> DataFrame:
    """The library's own labelled table (url, blocked)."""
    return spark.createDataFrame(url_labels.rows(), "url string, blocked boolean")
