"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, line_dedup, mixing, packing, quality, secrets, simhash, topk, url_filter, warc
from .common import table
from .oracles import oracle_sql
from .url_filter import Rule

__all__ = ["oracle_sql", "queries"]

URL_RULES = [
    Rule("block", "com/en/"),
    Rule("allow", "example.com/en/7"),
    Rule("allow", "net/de/"),
    Rule("block", "example.net/de/8"),
    Rule("block", "org/es/"),
]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every line that goes; all other lines stay."""
    return line_dedup.removed_lines(table(spark, sf_dir, "documents")).select("doc_id", "line_no", "line_id", "class_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


MIX_TARGETS = {"good": 0.9, "low": 0.08, "toxic": 0.02}


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated, model = mixing.mix(table(spark, sf_dir, "documents"), mixing.domains_of(table(spark, sf_dir, "labels")), MIX_TARGETS, keep=["doc_id"], anchor="good")
    shares = [F.round(F.element_at("posterior", i + 1), 6).alias(f"p_{d}") for i, d in enumerate(model.domains)]
    return rated.select("doc_id", "tokens", *shares, "rate", "copies")


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.search(vectors, vectors.where("vec_id % 50 = 0"), 10)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    counts = [secrets.count_of(F.col("base_spans"), kind).alias(f"n_{kind}") for kind in secrets.PATTERNS]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(F.col("base_spans")), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language.held_out(F.col("doc_id"))
    langs, model = language.train(docs.where(~out).select("doc_id", "text", "lang"))
    return language.predict(docs.select("doc_id", "text"), langs, model, keep=["doc_id"]).select("doc_id", out.alias("held_out"), "lang_pred", "score", "lang_shares")


def op8_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_round_trip(table(spark, sf_dir, "pages")).where("kind != 'gap'")
    return found.select("page_id", F.when(F.col("kind") == "response", F.length("payload").cast("long")).otherwise(F.col("declared_length")).alias("payload_bytes"), F.when(F.col("kind") == "response", F.col("payload_sha1")).otherwise(F.col("digest")).alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    model = url_filter.fit(url_filter.labelled(spark))
    return url_filter.judge(pages.select("page_id", "url"), URL_RULES, model).select("page_id", "host", "path", "rule", "verdict", F.round("block_probability", 6).alias("block_probability"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
