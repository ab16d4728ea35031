"""Mixing to target weights with soft membership.

A naive Bayes classifier on hashed words, fitted on a labelled table, gives each document
posterior probabilities of its domain. Distributed projected-gradient least squares then
finds a rate for each document, r >= 0, so that the expected tokens of the domains,
sum of rate * tokens * posterior, meet the targets. A rate of 2.3 means two copies, and a
third with probability 0.3.

The rates start at 1 and every step moves a document's rate by the residuals of its
domains, weighted by its posterior, so a document's rate depends on its own posterior
and on the residuals only. Residuals are a few numbers a step; they are the whole state,
nothing of the size of the corpus is kept between steps, and each step is one
aggregation without a shuffle of rows. Steps go on until every domain is within the
tolerance of its target, or no step comes nearer: targets that no rates reach leave the
least-squares rates, and a warning with the shares reached.

The labelled sample is bounded: the label rows of ``max_labels`` doc_ids, those with the
smallest hashes. All else covers all documents.

Defined results: a null or blank text has no tokens, the prior as its posterior, and
rate 1; label rows that are null or disagree are left out; without labels all documents
are of one domain; repeated rows, and rows without an id, are rated and drawn each; an
empty table gives an empty result.
Extra columns are kept by :func:`mix`.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, staged, words

BUCKETS = 1 << 13
SPARE = 1.02


@dataclass(frozen=True)
class Classifier:
    domains: tuple[str, ...]
    priors: tuple[float, ...]
    #: For each domain but the first, log-likelihood ratios of the buckets to the first.
    ratios: tuple[tuple[float, ...], ...]


def buckets(text: Column) -> Column:
    return F.transform(words(ascii_lower(text)), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def fit(docs: DataFrame, labelled: DataFrame, max_labels: int = 8192) -> Classifier:
    """Fit on ``labelled`` (doc_id, domain), joined to the texts of ``docs``."""
    clear = labelled.where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"), F.max("domain").alias("other")).where("domain = other")
    sample = clear.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels).select("doc_id", "domain")
    known = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # max_labels rows
    counted = known.select("domain", F.explode(buckets(F.coalesce("text", F.lit("")))).alias("bucket")).groupBy("domain", "bucket").count().collect()
    sizes = dict(known.groupBy("domain").count().collect())
    domains = sorted(sizes)
    if len(domains) < 2:
        return Classifier(tuple(domains) or ("all",), (1.0,), ())
    table = np.full((len(domains), BUCKETS), 0.5)
    for r in counted:
        table[domains.index(r["domain"]), r["bucket"]] += r["count"]
    logs = np.log(table / table.sum(1, keepdims=True))
    total = sum(sizes.values())
    return Classifier(tuple(domains), tuple(sizes[d] / total for d in domains), tuple(tuple(float(x) for x in logs[k] - logs[0]) for k in range(1, len(domains))))


def posteriors(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """Add tokens (words of the text) and posterior, an array in the order of the domains.

    Words of a text depend on each other; the evidence counts with the square root of
    their number.
    """
    ratios = [F.lit(np.array(r)) for r in model.ratios]

    def of(b: Column) -> Column:
        n = F.size(b)
        if not ratios:
            return F.struct(n.cast("long").alias("tokens"), F.array(F.lit(1.0)).alias("posterior"))
        scale = F.when(n > 0, 2 / F.sqrt(n)).otherwise(F.lit(0.0))
        scores = [F.lit(math.log(model.priors[0]))]
        for k, r in enumerate(ratios, 1):
            scores.append(math.log(model.priors[k]) + scale * F.aggregate(b, F.lit(0.0), lambda s, i: s + F.element_at(r, i + 1)))

        def softmax(s: Column) -> Column:
            top = F.array_max(s)
            return let(F.transform(s, lambda x: F.exp(x - top)), lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda z: F.transform(e, lambda x: x / z)))

        return F.struct(n.cast("long").alias("tokens"), let(F.array(*scores), softmax).alias("posterior"))

    return docs.withColumn("__m", let(buckets(F.coalesce(F.col(text), F.lit(""))), of)).withColumns({"tokens": F.col("__m.tokens"), "posterior": F.col("__m.posterior")}).drop("__m")


def rate(history: list[np.ndarray], ceiling: float) -> Column:
    """A document's rate after the steps of ``history``: each a scaled residual for each domain. Without tokens it is 1."""
    if not history:
        return F.lit(1.0)
    steps = F.lit(np.array(history).reshape(-1))
    k = len(history[0])

    def step(r: Column, j: Column) -> Column:
        move = F.lit(0.0)
        for d in range(k):
            move = move + F.element_at("posterior", d + 1) * F.element_at(steps, j * k + d + 1)
        return F.greatest(F.lit(0.0), F.least(F.lit(ceiling), r - move))

    return F.when(F.col("tokens") == 0, F.lit(1.0)).otherwise(F.aggregate(F.sequence(F.lit(0), F.lit(len(history) - 1)), F.lit(1.0), step))


def solve(rows: DataFrame, targets: dict[str, float], domains: tuple[str, ...], anchor: str | None = None, tolerance: float = 1e-3, ceiling: float = 1e6, patience: int = 8) -> tuple[list[np.ndarray], np.ndarray]:
    """Residual history and reached totals for staged ``rows`` (tokens, posterior).

    ``targets`` are shares of the mixed tokens, which are as many as there are, or, with an
    ``anchor``, so many that this domain keeps ``SPARE`` times its own tokens at least.
    The Gram matrix of the posteriors, weighted by the tokens of documents whose rate is
    at no bound, sets direction and length of a step. After ``patience`` steps that come
    no nearer than the best before them, the best stands.
    """
    k = len(domains)
    p = [F.element_at("posterior", d + 1) for d in range(k)]
    total = float(rows.agg(F.sum("tokens")).first()[0] or 0)
    if not total:
        return [], np.zeros(k)
    want = np.array([targets.get(d, 0.0) for d in domains])
    want = want / want.sum() if want.sum() else want
    if anchor in domains and want[domains.index(anchor)]:
        own = float(rows.agg(F.sum(F.col("tokens") * p[domains.index(anchor)])).first()[0] or 0) / total
        want = want * max(1.0, SPARE * own / want[domains.index(anchor)])
    history: list[np.ndarray] = []
    best, least, kept = np.zeros(k), np.inf, 0
    tokens, posterior, r = F.col("tokens"), [F.element_at("posterior", d + 1) for d in range(k)], F.col("__rate")
    free = F.when((r > 0) & (r < ceiling), tokens).otherwise(F.lit(0))
    while True:
        rated = rows.select("tokens", "posterior", rate(history, ceiling).alias("__rate"))
        sums = rated.agg(*[F.sum(tokens * posterior[d] * r) for d in range(k)], *[F.sum(free * posterior[a] * posterior[b]) for a in range(k) for b in range(k)]).first()
        reached = np.array([float(x or 0) for x in sums[:k]]) / total
        residual = reached - want
        far = np.abs(residual).max()
        if far < 0.99 * least:
            best, least, kept = reached, far, len(history)
        if far <= tolerance:
            break
        if len(history) - kept >= patience:
            warnings.warn(f"the targets cannot be reached: wanted {want.tolist()} of the tokens, reached {best.tolist()}", stacklevel=2)
            break
        # a projected gradient step, in the metric of the rates that are free to move; a small ridge keeps it well defined
        gram = np.array([float(x or 0) for x in sums[k:]]).reshape(k, k) / total
        metric = np.linalg.inv(gram + 1e-6 * max(np.trace(gram), 1e-9) * np.eye(k))
        history.append(metric @ residual)
    return history[:kept], best


def copies(r: Column, key: Column) -> Column:
    """Whole copies for a rate: the fraction is a probability, drawn by hash."""
    return F.floor(r + F.pmod(F.xxhash64(F.lit("mix"), key), F.lit(1 << 30)) / F.lit(1 << 30)).cast("int")


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of a table (doc_id, quality, toxic)."""
    domain = F.when(F.col("toxic") == 1, "toxic").when((F.col("quality") == 1) & (F.col("toxic") == 0), "good").when((F.col("quality") == 0) & (F.col("toxic") == 0), "low")
    return labels.select("doc_id", domain.alias("domain"))


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], keep: list[str] | None = None, anchor: str | None = None, max_labels: int = 8192) -> tuple[DataFrame, Classifier]:
    """``keep`` columns (default all), tokens, posterior, rate and copies of every row."""
    keep = docs.columns if keep is None else keep
    model = fit(docs, labelled, max_labels)
    scored = posteriors(docs.select(*keep, F.col("text").alias("__text")), model, "__text").drop("__text")
    rows = staged(scored.withColumn("__row", F.monotonically_increasing_id()), "mixing")  # as written; a lost task changes no draw
    history, _ = solve(rows, targets, model.domains, anchor)
    return rows.withColumn("rate", F.round(rate(history, 1e6), 6)).withColumn("copies", copies(F.col("rate"), F.col("__row"))).drop("__row"), model
