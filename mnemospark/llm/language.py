"""Language ID by mixtures: expectation-maximisation over n-gram likelihoods.

A text is a mixture of languages. From the byte n-grams of the whole text, EM estimates
the share of each language; the set of languages is the one with the best penalised
likelihood (BIC), grown from the strongest. The largest share names the text.

The model is learned from a bounded sample: the labelled rows of at most ``max_docs``
doc_ids, those with the smallest hashes. Its table has a row for each language of the
sample and a column for each hashed n-gram.

Defined results: a null text, or one without letters, is ``und`` with score 0; repeated
rows get equal results; an empty table gives an empty result; without labelled rows
every text is ``und``. Extra columns are kept by :func:`predict`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
UND = "und"
TOLERANCE = 1e-4


def has_letter(text: str) -> bool:
    """A character of a letter category; digits, fractions and letter-like numbers are none."""
    return any(map(str.isalpha, text))


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of the lower-cased text, with their counts."""
    b = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    v = ((b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))) >> np.uint32(17)
    if len(v) > BUCKETS // 4:
        n = np.bincount(v, minlength=BUCKETS)
        u = np.flatnonzero(n)
        return u, n[u].astype(float)
    if not len(v):
        return v, v.astype(float)
    v.sort()
    first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
    return v[first], np.diff(np.append(first, len(v))).astype(float)


def train(labelled: DataFrame, max_docs: int = 4000) -> tuple[list[str], np.ndarray]:
    """Languages and their n-gram probabilities from ``labelled`` (doc_id, text, lang)."""
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    order = F.xxhash64("doc_id")
    last = known.select(order.alias("h")).distinct().orderBy("h").limit(max_docs).agg(F.max("h")).first()[0]
    if last is None:
        return [], np.zeros((0, BUCKETS))
    sample = known.where(order <= last).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                u, c = grams(text)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u)), pa.array(u.astype("i4")), pa.array(c)], ["lang", "gram", "n"])

    rows = sample.mapInArrow(count, "lang string, gram int, n double").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r["lang"] for r in rows})
    at = {x: i for i, x in enumerate(langs)}
    counts = np.zeros((len(langs), BUCKETS))
    for r in rows:
        counts[at[r["lang"]], r["gram"]] = r["n"]
    smooth = counts + 0.05
    return langs, smooth / smooth.sum(1, keepdims=True)


def em(p: np.ndarray, c: np.ndarray, tolerance: float = TOLERANCE) -> tuple[np.ndarray, float]:
    """Shares of the columns of ``p`` and the log-likelihood of counts ``c``.

    Steps go on until none moves a share by more than ``tolerance``.
    """
    share = np.full(p.shape[1], 1 / p.shape[1])
    moved = len(share) > 1
    while moved:
        new = share * ((c / (p @ share)) @ p)
        new /= new.sum()
        moved = np.abs(new - share).max() > tolerance
        share = new
    return share, float(c @ np.log(p @ share))


def mixture(model: np.ndarray, text: str, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Languages of the chosen set, strongest first, and their shares."""
    u, c = grams(text)
    p = model[u]
    share, _ = em(p, c)
    order = np.argsort(-share, kind="stable")
    price = penalty * 0.5 * np.log(c.sum())
    chosen, best = order[:1], em(p[:, order[:1]], c)
    for k in range(2, len(order) + 1):
        tried = em(p[:, order[:k]], c)
        if tried[1] - best[1] <= price:
            break
        chosen, best = order[:k], tried
    by = np.argsort(-best[0], kind="stable")
    return chosen[by], best[0][by]


def predict(docs: DataFrame, langs: list[str], model: np.ndarray, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default all), lang_pred, score and lang_shares of every row."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score", "lang_shares")]
    shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(model.T))
    rows = docs.select(*keep, F.col(text).alias("__text"))
    out = rows.drop("__text").schema.add("lang_pred", "string").add("score", "double").add("lang_shares", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                if not langs or t is None or not has_letter(t):
                    found.append((UND, 0.0, ""))
                else:
                    which, share = mixture(shared.value, t)
                    found.append((langs[which[0]], float(min(1.0, share[0])), ",".join(f"{langs[i]}:{s:.3f}" for i, s in zip(which, share, strict=True))))
            columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], "lang_pred", "score", "lang_shares"])

    return rows.mapInArrow(run, out)


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))
