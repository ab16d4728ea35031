"""Writes as rewrites: upserts, idempotent inserts, flags, versions.

Plain files know no MERGE, so each operator joins the table with the changes on their
key and returns the new table; a batch with several changes of one key is folded first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDGE_KEY = ["source_id", "target_id", "relationship_type"]
CUSTOM = "Custom"

#: Allowed valence and arousal labels.
VALENCE = ["positive", "neutral", "negative", "mixed"]
AROUSAL = ["low", "medium", "high"]


def upsert_entities(store: DataFrame, batch: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Entities by lower-case trimmed name within ``scope``; adds action.

    The type only moves away from Custom, the summary is replaced by a non-empty one.
    """
    scope = ["organization_id", "project_id"] if scope is None else scope
    b = batch.withColumn("name", F.lower(F.trim("name"))).withColumn("at", F.monotonically_increasing_id() if "at" not in batch.columns else F.col("at"))
    typed = F.when(F.col("entity_type") != CUSTOM, F.struct(F.col("at"), F.col("entity_type")))
    said = F.when(F.coalesce(F.col("summary"), F.lit("")) != "", F.struct(F.col("at"), F.col("summary")))
    folded = b.groupBy(*scope, "name").agg(F.min("id").alias("b_id"), F.min(typed).alias("b_type"), F.max(said).alias("b_summary"))
    j = store.join(folded, [*scope, "name"], "full")
    new_type = F.coalesce(F.when(F.coalesce(F.col("entity_type"), F.lit(CUSTOM)) != CUSTOM, F.col("entity_type")), F.col("b_type.entity_type"), F.col("entity_type"), F.lit(CUSTOM))
    new_summary = F.coalesce(F.col("b_summary.summary"), F.col("summary"))
    changed = ~(new_type.eqNullSafe(F.col("entity_type")) & new_summary.eqNullSafe(F.col("summary")))
    action = F.when(F.col("id").isNull(), "created").when(F.col("b_id").isNotNull() & changed, "updated").otherwise("existing")
    return j.select(F.coalesce("id", "b_id").alias("id"), *scope, "name", new_type.alias("entity_type"), new_summary.alias("summary"), action.alias("action"))


def fold_edges(rows: DataFrame, now: Column) -> DataFrame:
    """One row of each edge key: greatest confidence, earliest start, latest end, an open end winning."""
    return rows.groupBy(*EDGE_KEY).agg(
        F.max("confidence").alias("confidence"), F.min(F.coalesce("valid_from", now)).alias("valid_from"),
        F.when(F.count_if(F.col("valid_to").isNull()) == 0, F.max("valid_to")).alias("valid_to"),
    )


def upsert_edges(store: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """Temporal upsert on active edges; closed edges stay as they are."""
    columns = [*EDGE_KEY, "confidence", "valid_from", "valid_to"]
    active = store.where("invalid_at is null").select(*columns)
    merged = fold_edges(active.unionByName(batch.select(*columns)), now).withColumn("invalid_at", F.lit(None).cast(store.schema["invalid_at"].dataType))
    return merged.unionByName(store.where("invalid_at is not null").select(*merged.columns))


def bulk_edges(store: DataFrame, batch: DataFrame) -> DataFrame:
    """Bulk upsert: on conflict only the confidence rises."""
    good = batch.where(F.col("source_id").isNotNull() & F.col("target_id").isNotNull() & F.col("relationship_type").isNotNull())
    folded = good.groupBy(*EDGE_KEY).agg(F.max("confidence").alias("__c"))
    return store.join(folded, EDGE_KEY, "full").select(*EDGE_KEY, F.greatest("confidence", "__c").alias("confidence"))


def upsert_observations(store: DataFrame, batch: DataFrame) -> DataFrame:
    """The latest payload of (project, subject, type, related or none); both have ``at``."""
    key = ["project_id", "subject_entity_id", "observation_type", F.coalesce(F.col("related_entity_id").cast("string"), F.lit("")).alias("__r")]
    names = ["project_id", "subject_entity_id", "observation_type", "__r"]
    payload = [c for c in store.columns]
    rows = store.unionByName(batch).withColumn("__r", key[3])
    return rows.groupBy(*names).agg(F.max_by(F.struct(*payload), "at").alias("p")).select("p.*")


def insert_missing(store: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``batch`` whose key is not stored, each key once: ON CONFLICT DO NOTHING."""
    return batch.join(store.select(*keys), keys, "left_anti").dropDuplicates(keys)


def dedup_ledger(store: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Like :func:`insert_missing`, the first row by ``order`` of each key."""
    first = batch.groupBy(*keys).agg(F.min_by(F.struct(*batch.columns), order).alias("b")).select("b.*")
    return first.join(store.select(*keys), keys, "left_anti")


def with_sequence(store: DataFrame, batch: DataFrame, session: str = "session_id", order: str = "position") -> DataFrame:
    """Number the batch of each session onwards from the greatest stored sequence."""
    last = store.groupBy(session).agg(F.max("sequence_number").alias("__last"))
    n = F.row_number().over(Window.partitionBy(session).orderBy(order))
    return batch.join(last, session, "left").withColumn("sequence_number", F.coalesce(F.col("__last") + n, n - 1)).drop("__last")


def set_bits(store: DataFrame, marks: DataFrame, key: str = "id", status: str = "enrichment_status") -> DataFrame:
    """OR the bits of ``marks`` (key, bit) into the status."""
    folded = marks.groupBy(key).agg(F.bit_or("bit").alias("__b"))
    return store.join(folded, key, "left").withColumn(status, F.col(status).bitwiseOR(F.coalesce("__b", F.lit(0)))).drop("__b")


def unmarked(store: DataFrame, bit: int, status: str = "enrichment_status") -> DataFrame:
    return store.where(F.col(status).bitwiseAND(F.lit(bit)) == 0)


def wipe_project(episodes: DataFrame, facts: DataFrame, project_id: object, now: Column) -> tuple[DataFrame, DataFrame]:
    """Soft-delete a project's episodes and invalidate its facts."""
    mine = F.col("project_id") == project_id
    return episodes.withColumn("is_deleted", F.col("is_deleted") | mine), facts.withColumn("invalid_at", F.when(mine & F.col("invalid_at").isNull(), now).otherwise(F.col("invalid_at")))


def merge_patch(old: Column, patch: Column) -> Column:
    """JSON objects of depth two: a null deletes a key, objects merge one level, all else replaces."""
    kind = "map<string,string>"

    def as_map(c: Column) -> Column:
        return F.coalesce(F.from_json(c, kind), F.from_json(F.lit("{}"), kind))

    def both_objects(a: Column, b: Column) -> Column:
        return F.coalesce(a.startswith("{") & b.startswith("{"), F.lit(False))

    def inner(a: Column, b: Column) -> Column:
        return F.to_json(F.map_zip_with(F.from_json(a, kind), F.from_json(b, kind), lambda _, x, y: F.coalesce(y, x)))

    merged = F.map_zip_with(as_map(old), as_map(patch), lambda _, a, b: F.when(both_objects(a, b), inner(a, b)).otherwise(F.coalesce(b, a)))
    dropped = F.map_keys(F.map_filter(as_map(patch), lambda _, v: v.isNull()))
    return F.map_filter(merged, lambda k, _: ~F.array_contains(dropped, k))


def apply_updates(store: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Partial update: non-null values of ``updates`` replace those stored."""
    u = updates.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    out = store.join(u, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"__{c}", c)).drop(f"__{c}")
    return out


def get_or_create(store: DataFrame, batch: DataFrame, external: str = "external_id") -> DataFrame:
    """Every external id of the batch with its stored id, or a derived new one; adds created."""
    wanted = batch.select(external).distinct().join(store.select(external, "id"), external, "left")
    return wanted.withColumn("created", F.col("id").isNull()).withColumn("id", F.coalesce(F.col("id").cast("string"), F.substring(F.sha2(F.col(external).cast("string"), 256), 1, 32)))


def remap(child: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Re-point ``column`` by ``mapping`` (old_id, new_id)."""
    m = mapping.select(F.col("old_id").alias(column), F.col("new_id").alias("__new"))
    return child.join(m, column, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def new_versions(templates: DataFrame, batch: DataFrame) -> DataFrame:
    """Append versions of templates (name, version, body, is_active, is_default): older ones turn inactive."""
    w = Window.partitionBy("name")
    top = templates.groupBy("name").agg(F.max("version").alias("__v"), F.max("is_default").alias("__d"))
    n = F.row_number().over(w.orderBy("position"))
    new = batch.join(top, "name", "left").select("name", (F.coalesce("__v", F.lit(0)) + n).alias("version"), "body", F.coalesce("__d", F.lit(False)).alias("is_default"))
    old = templates.select("name", "version", "body", "is_default")
    return old.unionByName(new).withColumn("is_active", F.col("version") == F.max("version").over(w)).withColumn("is_default", F.col("is_default") & F.col("is_active"))


def classification_rows(rows: DataFrame, store: DataFrame, intents: list[str], emotions: list[str]) -> DataFrame:
    """Labels outside their sets become null, confidence is brought to 0..1, stored episodes are skipped."""
    out = rows
    for c, allowed in (("intent", intents), ("emotion", emotions), ("valence", VALENCE), ("arousal", AROUSAL)):
        out = out.withColumn(c, F.when(F.col(c).isin(allowed), F.col(c)))
    out = out.withColumn("confidence", F.least(F.greatest(F.col("confidence"), F.lit(0.0)), F.lit(1.0)))
    return insert_missing(store, out, ["organization_id", "episode_id"])


def subscribed(endpoints: DataFrame, event: str, column: str = "events") -> DataFrame:
    """Endpoints for an event: an empty JSON list means all, a malformed one none."""
    listed = F.from_json(column, "array<string>", {"mode": "PERMISSIVE"})
    well_formed = F.trim(F.col(column)).startswith("[") & listed.isNotNull()
    return endpoints.where(F.coalesce(well_formed & ((F.size(listed) == 0) | F.array_contains(listed, event)), F.lit(False)))
