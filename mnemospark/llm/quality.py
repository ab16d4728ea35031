"""Quality rules: text measures, then lines that too many documents of a host share.

Every line is normalised (lower case, white space collapsed) and hashed; a line that
more than ``max_documents`` distinct documents of one host contain is boilerplate there,
and goes. A document that loses more than ``max_lost`` of its words that way is
depleted, and rejected. Documents are counted by doc_id, so copies with ids of their own
count each; rows without an id count by their text.

Only hashes are shuffled, never texts. The lines are split and hashed once, and staged.
Counting groups by (host, line, document) first, and the rows of a hot line are salted
before they meet its verdict.

Defined results: a null or blank text has no words and fails the base rules; a null host
is a host of its own; repeated rows get equal results; an empty table gives an empty
result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITESPACE, let, staged, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8
SALTS = 16


def _shifted(h: Column, by: int) -> Column:
    """Hashes of the pairs (i, i + by)."""
    n = F.greatest(F.lit(0), F.size(h) - by)
    return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(1 + by), n), lambda a, b: F.xxhash64(a, b))


def repeat_words(w: Column) -> Column:
    """Words in ``WINDOW``-word windows that occur twice or more, the first one included."""

    def covered(h: Column) -> Column:
        def marks(s: Column) -> Column:
            m = F.size(s)
            twin = F.zip_with(F.slice(s, F.lit(1), m - 1), F.slice(s, F.lit(2), m - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
            at = F.array_sort(F.array_distinct(F.flatten(F.filter(twin, lambda x: x.isNotNull()))))
            return let(at, lambda at: F.lit(WINDOW) + F.aggregate(F.zip_with(F.slice(at, F.lit(1), F.size(at) - 1), F.slice(at, F.lit(2), F.size(at) - 1), lambda a, b: F.least(F.lit(WINDOW), b - a)), F.lit(0), lambda s, x: s + x))

        rows = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(rows, marks)).cast("long")

    def windows(w: Column) -> Column:
        return let(let(let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: _shifted(h, 1)), lambda h: _shifted(h, 2)), lambda h: let(_shifted(h, 4), covered))

    return F.when(F.size(w) > WINDOW, windows(w)).otherwise(F.lit(0).cast("long"))


def measures(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    whole = F.coalesce(text, F.lit(""))
    solid = F.translate(whole, WHITESPACE + " ", "")
    lines = F.filter(F.split(whole, "\n"), lambda x: F.length(F.translate(x, WHITESPACE + " ", "")) > 0)
    return let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(solid).cast("long").alias("word_chars"),
            (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeat_words(w).alias("n_repeat_words"),
        ),
    )


def _key(host: str) -> list[Column]:
    return [F.col("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash"), F.xxhash64(F.lit(1), F.col(host)).alias("host_hash")]


def line_hashes(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, text_hash, host_hash, line_hash, line_words: a row for every line with a word."""
    line = F.explode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"))
    w = words(F.lower(F.col("line")))
    return (
        docs.select(*_key(host), line.alias("line"))
        .select("doc_id", "text_hash", "host_hash", let(w, lambda w: F.struct(F.xxhash64(w).alias("h"), F.size(w).alias("n"))).alias("l"))
        .where("l.n > 0")
        .select("doc_id", "text_hash", "host_hash", F.col("l.h").alias("line_hash"), F.col("l.n").alias("line_words"))
    )


def frequent_lines(lines: DataFrame, max_documents: int) -> DataFrame:
    """host_hash, line_hash and documents of the lines above the limit."""
    document = F.xxhash64(F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("string"), F.col("text_hash").cast("string")))
    seen = lines.select("host_hash", "line_hash", document.alias("document")).distinct()
    return seen.groupBy("host_hash", "line_hash").agg(F.count(F.lit(1)).alias("documents")).where(F.col("documents") > max_documents)


def assess(docs: DataFrame, host: str = "source", max_documents: int = 50, max_lost: float = 0.5, min_words: int = 20) -> DataFrame:
    """doc_id, the measures, base_failed, lost_words and kept, a row for each document."""
    lines = staged(line_hashes(docs, host), "line_hashes")
    frequent = frequent_lines(lines, max_documents).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS)).cast("int"))
    removed = salted.join(frequent, ["host_hash", "line_hash", "salt"]).groupBy("doc_id", "text_hash", "host_hash", "line_hash").agg(F.sum("line_words").alias("n"))
    # repeated rows share a key: their lines came once for each row
    copies = docs.select(*_key(host)).groupBy("doc_id", "text_hash", "host_hash").agg(F.count(F.lit(1)).alias("copies"))
    per_doc = removed.groupBy("doc_id", "text_hash", "host_hash").agg(F.sum("n").alias("removed"))
    lost = copies.join(per_doc.withColumnsRenamed({"doc_id": "d", "text_hash": "t", "host_hash": "h"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")) & (F.col("host_hash") == F.col("h"))).select("d", "t", "h", (F.col("removed") / F.col("copies")).cast("long").alias("lost"))
    base = docs.select(*_key(host), measures(F.col("text")).alias("m")).select("doc_id", "text_hash", "host_hash", "m.*")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        base.join(lost, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")) & (F.col("host_hash") == F.col("h")), "left")
        .withColumn("lost_words", F.coalesce("lost", F.lit(0)).cast("long"))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("lost_words") <= max_lost * F.col("n_words")))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words")
    )


def clean(docs: DataFrame, host: str = "source", max_documents: int = 50) -> DataFrame:
    """The rows with their frequent lines removed from ``text``.

    Host and line hashes of one document are few, so each document carries its own list
    of removed hashes to its text; a document without such lines is not shuffled to them.
    """
    lines = line_hashes(docs, host)
    hit = lines.join(frequent_lines(lines, max_documents).hint("merge"), ["host_hash", "line_hash"])
    gone = hit.groupBy(F.col("text_hash").alias("t"), F.col("host_hash").alias("h")).agg(F.collect_set("line_hash").alias("gone"))
    key = _key(host)
    kept = F.concat_ws("\n", F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(F.col("gone"), F.xxhash64(words(F.lower(x))))))
    return docs.join(gone, (key[1] == F.col("t")) & (key[2] == F.col("h")), "left").withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept)).drop("t", "h", "gone")
