"""Column expressions on text: identity terms, trigrams, the analyzer, hashes, cursors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that the analyzer drops.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with"]


def identity_term(c: Column) -> Column:
    """Lower case, without anything but a-z, 0-9 and white space, trimmed; null becomes empty."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", "")), F.lit(""))


def tokens(c: Column) -> Column:
    """Analyzer: lower case, split at all but a-z and 0-9, stop words dropped."""
    parts = F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+")
    return F.filter(parts, lambda t: (t != "") & ~t.isin(STOP_WORDS))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the words, each word padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")

    def of(w: Column) -> Column:
        padded = F.concat(F.lit("  "), w, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words, of)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def trigram_similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def capitalised_words(c: Column) -> Column:
    """Words of three or more characters that start in upper case, bare of .,!?:; at their ends."""
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: (F.length(w) > 2) & w.rlike("^[A-Z]"))
    return F.transform(parts, lambda w: F.regexp_replace(w, "^[.,!?:;]+|[.,!?:;]+$", ""))


def display_name(name: Column, mention: Column) -> Column:
    """The mention, where longer than a character; else the name, capitalised if all lower case."""
    capital = F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.length(name)))
    return F.when(F.length(mention) > 1, mention).when(name == F.lower(name), capital).otherwise(name)


def edge_type(c: Column) -> Column:
    """The type, where it has letters, digits and underscores only; else null, to be rejected."""
    return F.when(c.rlike("^[a-zA-Z0-9_]+$"), c)


def unit_score(raw: Column) -> Column:
    """A score of 0 or more, brought to 0..1."""
    return 1 - 1 / (1 + raw)


def content_hash(*columns: str) -> Column:
    """SHA-256 of the JSON object of the columns, keys sorted, nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def cache_key(query: Column, as_of: Column | None = None) -> Column:
    key = F.substring(F.sha2(query, 256), 1, 16)
    return key if as_of is None else F.concat_ws(":", key, as_of)


def encode_cursor(*parts: Column) -> Column:
    """Base64url of the parts, separated by bars."""
    return F.translate(F.base64(F.encode(F.concat_ws("|", *parts), "UTF-8")), "+/\n\r", "-_")


def decode_cursor(cursor: Column) -> Column:
    return F.split(F.decode(F.unbase64(F.translate(cursor, "-_", "+/")), "UTF-8"), r"\|")
