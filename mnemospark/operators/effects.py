"""What follows a committed change: webhook events, cache purges and graph updates, as one table.

A batch's effects are rows that are written with the batch, so a batch that fails leaves
none, and a replayed batch leaves the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Event types of the data operators, by what happened to what.
EVENT_TYPES = {
    ("session", "created"): "session.created",
    ("session", "closed"): "session.closed",
    ("message", "created"): "message.added",
    ("episode", "processed"): "episode.processed",
    ("batch", "completed"): "ingest.batch.completed",
    ("episode", "completed"): "ingest.episode.completed",
    ("entity", "created"): "graph.entity.created",
    ("entity", "updated"): "graph.entity.updated",
    ("edge", "created"): "graph.edge.created",
    ("fact", "created"): "fact.extracted",
    ("fact", "deleted"): "fact.deleted",
    ("fact", "superseded"): "fact.superseded",
    ("fact", "retracted"): "fact.retracted",
    ("fact", "llm_invalidated"): "fact.invalidated",
    ("classification", "created"): "classification.created",
    ("extraction", "created"): "extraction.created",
    ("user", "created"): "user.created",
}


def event_type(what: Column, happened: Column) -> Column:
    """Name of the event; null where none is sent."""
    out = F.lit(None).cast("string")
    for (a, b), name in EVENT_TYPES.items():
        out = F.when((what == a) & (happened == b), name).otherwise(out)
    return out


def effects(changes: DataFrame) -> DataFrame:
    """organization_id, effect, event_type and id: a webhook row for each change that has an event,
    and one cache purge for each organization with a change of facts or entities.

    ``changes`` has organization_id, what, happened and id.
    """
    named = changes.withColumn("event_type", event_type(F.col("what"), F.col("happened")))
    hooks = named.where("event_type is not null").select("organization_id", F.lit("webhook").alias("effect"), "event_type", F.col("id").cast("string").alias("id"))
    purges = changes.where(F.col("what").isin("fact", "entity", "edge")).select("organization_id").distinct()
    return hooks.unionByName(purges.select("organization_id", F.lit("purge").alias("effect"), F.lit(None).cast("string").alias("event_type"), F.lit("context:*").alias("id")))


def job_status(results: DataFrame, keys: list[str]) -> DataFrame:
    """Status of a job for each tenant, from the outcome (ok, failed, skipped) of its parts.

    All failed is an error, some failed partial; without a part that ran it is skipped.
    """
    ok, failed = F.count_if(F.col("outcome") == "ok"), F.count_if(F.col("outcome") == "failed")
    counts = results.groupBy(*keys).agg(ok.alias("succeeded"), failed.alias("failed"))
    status = F.when(F.col("succeeded") + F.col("failed") == 0, "skipped").when(F.col("succeeded") == 0, "error").when(F.col("failed") > 0, "partial").otherwise("completed")
    return counts.withColumn("status", status)
