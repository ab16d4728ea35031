"""Readers: tenant scans, blobs, and the adapter from the star-schema tables to the logical ones.

Tables are scanned as Parquet, so filters and column selections reach the files. The
adapter's columns are expressions over one scan each, or equi joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPOCH = "2024-01-01 00:00:00"


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def tenant_scope(df: DataFrame, organization_id: object = None, project_id: object = None) -> DataFrame:
    """Rows of a tenant; every reader of tenant data goes through it."""
    for name, value in (("organization_id", organization_id), ("project_id", project_id)):
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def live(df: DataFrame) -> DataFrame:
    """Rows that are not soft-deleted."""
    return df.where(~F.coalesce(F.col("is_deleted"), F.lit(False)))


def by_ids(df: DataFrame, ids: list | DataFrame, key: str = "id") -> DataFrame:
    """Batch lookup: a literal list is pushed to the scan, a table is semi-joined."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")
    return df.where(F.col(key).isin(ids))


def blobs(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files of a folder: path, modificationTime, length, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def instant(minutes: Column) -> Column:
    """EPOCH plus minutes, a timestamp without time zone."""
    return F.expr(f"timestamp_ntz'{EPOCH}'") + F.make_dt_interval(mins=minutes.cast("int"))


def episodes(spark: SparkSession, path: str) -> DataFrame:
    """Conversation turns as episodes: an hour between sessions, a minute between turns."""
    c = read(spark, path, "conversations")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("session_id"), (F.col("conv_id") % 4).alias("project_id"),
        F.col("turn").alias("sequence_number"), "role", F.col("text").alias("content"), instant(F.col("conv_id") * 60 + F.col("turn")).alias("created_at"),
        (F.col("conv_id") * 7 + F.col("turn") * 3).cast("int").bitwiseAND(F.lit(63)).alias("enrichment_status"),
    )


def facts(spark: SparkSession, path: str) -> DataFrame:
    """Events as facts: the user, the event type, the value's tens; valid until the next of that kind.

    Errors of a value above 50 are retracted at their time.
    """
    e = read(spark, path, "events")
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("subject"), F.col("event_type").alias("predicate"), F.floor(F.col("value") / 10).cast("long").alias("object"),
        (F.col("event_id") % 50).alias("source_episode_id"), F.col("ts").alias("valid_from"), F.lead("ts").over(w).alias("valid_to"),
        F.when((F.col("event_type") == "error") & (F.col("value") > 50), F.col("ts")).alias("invalid_at"), F.col("value"),
    )


def entities(spark: SparkSession, path: str) -> DataFrame:
    """Suppliers, customers, nations and regions as typed entities with prefixed ids."""
    parts = [("supplier", "s", "s_suppkey", "s_name"), ("customer", "c", "c_custkey", "c_name"), ("nation", "n", "n_nationkey", "n_name"), ("region", "r", "r_regionkey", "r_name")]
    out = None
    for table, prefix, key, name in parts:
        one = read(spark, path, table).select(F.concat(F.lit(prefix + ":"), F.col(key).cast("string")).alias("id"), F.col(name).alias("name"), F.lit(table).alias("entity_type"))
        out = one if out is None else out.unionByName(one)
    return out


def relationships(spark: SparkSession, path: str) -> DataFrame:
    """located_in edges: supplier and customer to nation, nation to region."""
    parts = [("supplier", "s", "s_suppkey", "n", "s_nationkey"), ("customer", "c", "c_custkey", "n", "c_nationkey"), ("nation", "n", "n_nationkey", "r", "n_regionkey")]
    out = None
    for table, a, key, b, to in parts:
        one = read(spark, path, table).select(F.concat(F.lit(a + ":"), F.col(key).cast("string")).alias("source_id"), F.concat(F.lit(b + ":"), F.col(to).cast("string")).alias("target_id"), F.lit("located_in").alias("relationship_type"))
        out = one if out is None else out.unionByName(one)
    return out


def temporal_edges(spark: SparkSession, path: str) -> DataFrame:
    """Customer to supplier edges, valid between order and shipment, whichever comes first."""
    o, li = read(spark, path, "orders"), read(spark, path, "lineitem")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(
        F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("source_id"), F.concat(F.lit("s:"), F.col("l_suppkey").cast("string")).alias("target_id"), F.lit("bought_from").alias("relationship_type"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.least("o_orderdate", "l_shipdate").alias("valid_from"), F.greatest("o_orderdate", "l_shipdate").alias("valid_to"),
        (F.col("l_quantity") / 50).alias("confidence"), F.lit(None).cast("timestamp_ntz").alias("invalid_at"),
    )


def links(spark: SparkSession, path: str) -> DataFrame:
    """Mentions: an order is an episode, its suppliers are the entities."""
    return read(spark, path, "lineitem").select(F.col("l_orderkey").alias("episode_id"), F.col("l_suppkey").alias("entity_id")).distinct()
