"""Personal data: detectors, overlap merge, masking; all in column expressions.

Positions come from the pieces that a split at the matches leaves between them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The formats to be found.
PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "phone": r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{2,4}\)?[-.\s]?\d{3,4}[-.\s]?\d{3,4}\b",
    "ssn": r"\b\d{3}[-.\s]?\d{2}[-.\s]?\d{4}\b",
    "credit_card": r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
    "ip_address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "api_key": r"\b(?:sk-[a-zA-Z0-9]{20,}|sk-proj-[a-zA-Z0-9]{20,}|ghp_[a-zA-Z0-9]{36,}|AKIA[0-9A-Z]{16})\b",
    "crypto_wallet": r"\b(0x[a-fA-F0-9]{40}|bc1[a-zA-Z0-9]{25,39})\b",
}
#: The labels of masked spans.
LABELS = {
    "email": "EMAIL",
    "phone": "PHONE",
    "ssn": "SSN",
    "credit_card": "CARD",
    "ip_address": "IP",
    "api_key": "KEY",
    "crypto_wallet": "WALLET",
}
CONFIDENCE = 0.95
SPAN = "array<struct<start:int,rank:int,end:int,type:string,confidence:double>>"


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def matches(text: Column, kind: str) -> Column:
    """Spans of one detector, in code points, end exclusive."""
    pattern, rank = PATTERNS[kind], list(PATTERNS).index(kind)

    def place(hits: Column) -> Column:
        gaps = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), hits, lambda p, h: F.struct(F.length(p).alias("gap"), F.length(h).alias("n")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

        def step(acc: Column, g: Column) -> Column:
            begin = acc["at"] + g["gap"]
            span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), (begin + g["n"]).alias("end"), F.lit(kind).alias("type"), F.lit(CONFIDENCE).alias("confidence"))
            return F.struct((begin + g["n"]).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        return F.when(F.size(hits) > 0, F.aggregate(gaps, start, step)["out"]).otherwise(F.array().cast(SPAN))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def merge_overlaps(spans: Column) -> Column:
    """By start, longer first; an overlap with the last span kept goes to the longer, then the more certain."""
    order = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["end"] != b["end"], b["end"] - a["end"]).otherwise(a["rank"] - b["rank"]))

    def step(kept: Column, s: Column) -> Column:
        last = F.element_at(kept, -1)
        wins = ((s["end"] - s["start"]) > (last["end"] - last["start"])) | (((s["end"] - s["start"]) == (last["end"] - last["start"])) & (s["confidence"] > last["confidence"]))
        return (
            F.when(F.size(kept) == 0, F.array(s)).when(s["start"] >= last["end"], F.concat(kept, F.array(s)))
            .when(wins, F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(s))).otherwise(kept)
        )

    return F.aggregate(order, F.array().cast(SPAN), step)


def detect(text: Column, kinds: list[str] | None = None, least: float = 0.7) -> Column:
    """Merged spans of all detectors, or of ``kinds``, with at least the confidence ``least``."""
    whole = F.coalesce(text, F.lit(""))
    found = F.concat(*[matches(whole, k) for k in kinds or PATTERNS])
    return merge_overlaps(F.filter(found, lambda s: s["confidence"] >= least))


def label(kind: Column) -> Column:
    out = F.upper(kind)
    for k, v in LABELS.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def mask(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its label."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], before, F.lit("[REDACTED:"), label(s["type"]), F.lit("]")).alias("out"))

    return F.when(F.size(spans) == 0, text).otherwise(_let(F.aggregate(spans, start, step), lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text)))))
