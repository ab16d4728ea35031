"""The bitemporal fact store: reads, exclusion, supersession, retraction, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.temporal import born_dead, effective_at, effective_in, hours_between, overlaps
from ..functions.text import identity_term

TRIPLE = ["subject", "predicate", "object"]

#: Predicates that name the same relation.
SYNONYMS = {
    "works_at": ["employed_at", "works_for", "employed_by", "joins"],
    "friend_of": ["friends_with", "shares_friend_with", "has_friend"],
    "colleague_of": ["coworker_of", "works_with", "teammate_of"],
    "studied_at": ["attended", "went_to", "graduated_from"],
    "likes": ["loves", "enjoys", "prefers"],
    "has_number_of_friends": ["has_friend_count", "friend_count", "num_friends"],
    "tech_lead_of": ["leads", "tech_lead_for", "leads_tech_for"],
    "graduated_from": ["completed", "finished", "graduated"],
}


def at_time(facts: DataFrame, t: Column, limit: int = 200, offset: int = 0) -> DataFrame:
    """Facts visible at ``t``, newest first."""
    return facts.where(effective_at(t)).orderBy(F.desc_nulls_last("valid_from"), "id").offset(offset).limit(min(limit, 200))


def in_range(facts: DataFrame, start: Column, end: Column) -> DataFrame:
    return facts.where(effective_in(start, end)).orderBy(F.asc_nulls_first("valid_from"), "id")


def active(facts: DataFrame, now: Column) -> DataFrame:
    return facts.where(effective_at(now)).orderBy(F.asc_nulls_first("valid_from"), "id")


def overlap_pairs(facts: DataFrame, keys: list[str], apart: Column | None = None) -> DataFrame:
    """Pairs a < b of one key whose validity overlaps; ``apart`` may compare ``a`` and ``b`` further.

    The key equality makes it a hash join; only rows that share a key are compared.
    """
    a, b = facts.alias("a"), facts.alias("b")
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    on = same & (F.col("a.id") < F.col("b.id")) & overlaps(F.col("a.valid_from"), F.col("a.valid_to"), F.col("b.valid_from"), F.col("b.valid_to"))
    return a.join(b, on if apart is None else on & apart).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), *[F.col(f"a.{k}").alias(k) for k in keys])


def conflicts_across_episodes(facts: DataFrame) -> DataFrame:
    return overlap_pairs(facts, TRIPLE, F.col("a.source_episode_id") != F.col("b.source_episode_id"))


def conflicts_in_episode(facts: DataFrame) -> DataFrame:
    return overlap_pairs(facts, [*TRIPLE, "source_episode_id"])


def range_checks(facts: DataFrame, now: Column, ahead_hours: int = 24) -> DataFrame:
    """id, issue and hours_ahead: invalid_range and future_date findings."""
    invalid = facts.where(F.col("valid_to") < F.col("valid_from")).select("id", F.lit("invalid_range").alias("issue"), F.lit(None).cast("double").alias("hours_ahead"))
    ahead = hours_between(now, F.col("valid_from"))
    return invalid.unionByName(facts.where(ahead > ahead_hours).select("id", F.lit("future_date").alias("issue"), F.round(ahead, 1).alias("hours_ahead")))


def identity(subject_entity: Column | None = None, object_entity: Column | None = None) -> Column:
    """Identity of a fact: entity ids and the raw predicate where both ends are resolved, else normalised names."""
    names = F.concat_ws("\u0001", F.lit("n"), identity_term(F.col("subject")), identity_term(F.col("predicate")), identity_term(F.col("object")))
    if subject_entity is None or object_entity is None:
        return names
    return F.when(subject_entity.isNotNull() & object_entity.isNotNull(), F.concat_ws("\u0001", F.lit("e"), subject_entity, F.col("predicate"), object_entity)).otherwise(names)


def supersede(history: DataFrame, keys: list[str], content: str, at: str, tie: str) -> DataFrame:
    """Fold of each identity in time order: equal consecutive content is skipped, new content closes the old.

    Adds valid_from, valid_to (the time of the successor) and superseded_by (its ``tie``).
    Two windows over one partitioning: one shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(at, tie)
    changed = history.withColumn("__before", F.lag(content).over(w)).withColumn("__n", F.row_number().over(w))
    kept = changed.where((F.col("__n") == 1) | ~F.col(content).eqNullSafe(F.col("__before"))).drop("__before", "__n")
    return kept.withColumn("valid_from", F.col(at)).withColumn("valid_to", F.lead(at).over(w)).withColumn("superseded_by", F.lead(tie).over(w))


def ingest(store: DataFrame, batch: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Supersession ingest: the new store, the rows inserted, and the lineage events.

    ``store`` and ``batch`` have organization_id, id, subject, predicate, object, content,
    subject_entity_id, object_entity_id, valid_from, valid_to and invalid_at. A batch is
    free of exact duplicates after this; a fact equal in identity and content to the
    active one is skipped, another content closes it.
    """
    key = identity(F.col("subject_entity_id"), F.col("object_entity_id"))
    first = Window.partitionBy("organization_id", "__key", "content").orderBy("id")
    fresh = batch.withColumn("__key", key).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    keyed = store.withColumn("__key", key)
    current = keyed.where(effective_at(now)).select("organization_id", "__key", F.col("content").alias("old_content"), F.col("id").alias("old_id"))
    equal = current.select("organization_id", "__key", F.col("old_content").alias("content"))
    new = fresh.join(equal, ["organization_id", "__key", "content"], "left_anti")
    order = Window.partitionBy("organization_id", "__key").orderBy("id")
    inserted = new.withColumn("valid_from", F.coalesce("valid_from", now)).withColumn("__next", F.lead("id").over(order)).withColumn("valid_to", F.when(F.col("__next").isNotNull(), now).otherwise(F.col("valid_to")))
    heads = new.withColumn("__n", F.row_number().over(order)).where("__n = 1").select("organization_id", "__key", F.col("id").alias("new_id"))
    closing = current.join(heads, ["organization_id", "__key"]).select("organization_id", "old_id", "new_id")
    chain = inserted.where("__next is not null").select("organization_id", F.col("id").alias("old_id"), F.col("__next").alias("new_id"))
    events = closing.unionByName(chain).withColumn("kind", F.lit("superseded")).withColumn("at_time", now)
    closed = store.join(closing.select("organization_id", F.col("old_id").alias("id"), F.lit(True).alias("__closed")), ["organization_id", "id"], "left").withColumn("valid_to", F.when(F.col("__closed"), now).otherwise(F.col("valid_to"))).drop("__closed")
    inserted = inserted.drop("__key", "__next")
    return closed.unionByName(inserted.select(*closed.columns)), inserted, events


def exclude(store: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of ``batch`` that overlap no live row of the same episode and triple.

    Both store and batch rows block; within the batch the first, by id, stays. A null in
    the key never conflicts. The fold over one key's batch is sequential by nature: it runs
    as an ordered fold over the key's intervals, which share an episode and a triple.
    """
    keys = ["source_episode_id", *TRIPLE]
    rows = batch.where(~born_dead())
    b, s = rows.alias("b"), store.where("invalid_at is null").alias("s")
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"b.{k}") == F.col(f"s.{k}"))
    free = b.join(s, same & overlaps(F.col("b.valid_from"), F.col("b.valid_to"), F.col("s.valid_from"), F.col("s.valid_to")), "left_anti")
    open_key = F.lit(False)
    for k in keys:
        open_key = open_key | F.col(k).isNull()
    span = F.array_sort(F.collect_list(F.struct("id", "valid_from", "valid_to"))).alias("spans")

    def step(kept: Column, x: Column) -> Column:
        return F.when(F.exists(kept, lambda y: overlaps(x["valid_from"], x["valid_to"], y["valid_from"], y["valid_to"])), kept).otherwise(F.concat(kept, F.array(x)))

    folded = free.where(~open_key).groupBy(*keys).agg(span).select(F.explode(F.aggregate("spans", F.slice("spans", 1, 0), step)).alias("x")).select(F.col("x.id").alias("id"))
    return free.where(open_key).unionByName(free.join(folded, "id", "left_semi"))


def retract(store: DataFrame, ids: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Stamp invalid_at on facts that are neither retracted nor closed; the store and the events."""
    hit = store.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    fresh = F.coalesce(F.col("__hit"), F.lit(False)) & F.col("invalid_at").isNull() & F.col("valid_to").isNull()
    events = hit.where(fresh).select(F.col("id").alias("old_id"), F.lit(None).cast(store.schema["id"].dataType).alias("new_id"), F.lit("retracted").alias("kind"), now.alias("at_time"))
    return hit.withColumn("invalid_at", F.when(fresh, now).otherwise(F.col("invalid_at"))).drop("__hit"), events


def invalidate(store: DataFrame, references: DataFrame, commands: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Close the facts that ``commands`` (ref, reason) name through ``references`` (ref, id).

    Returns the store, the events, and the commands whose reference is unknown. Closed or
    retracted facts are skipped.
    """
    known = commands.join(references, "ref")
    unknown = commands.join(references, "ref", "left_anti")
    hit = store.join(known.groupBy("id").agg(F.min("reason").alias("__reason"), F.lit(True).alias("__hit")), "id", "left")
    fresh = F.coalesce(F.col("__hit"), F.lit(False)) & F.col("invalid_at").isNull() & F.col("valid_to").isNull()
    events = hit.where(fresh).select(F.col("id").alias("old_id"), F.lit("llm_invalidated").alias("kind"), F.col("__reason").alias("reason"), now.alias("at_time"))
    return hit.withColumn("valid_to", F.when(fresh, now).otherwise(F.col("valid_to"))).drop("__hit", "__reason"), events, unknown


def lineage(events: DataFrame, fact_id: object, limit: int = 50, offset: int = 0) -> DataFrame:
    return events.where((F.col("old_id") == fact_id) | (F.col("new_id") == fact_id)).orderBy(F.desc("at_time"), "old_id").offset(offset).limit(limit)


def complete(facts: DataFrame, least: float = 0.3, missing: float = 0.5) -> DataFrame:
    """Facts with all of the triple, enough confidence, and a range with an instant in it."""
    solid = F.lit(True)
    for c in TRIPLE:
        solid = solid & (F.trim(F.coalesce(F.col(c), F.lit(""))) != "")
    return facts.where(solid & (F.coalesce(F.col("confidence"), F.lit(missing)) >= least) & ~born_dead())


def expand_predicate(predicate: Column) -> Column:
    """The predicate with its synonyms, one hop either way."""
    out = F.array(predicate)
    for name, others in SYNONYMS.items():
        group = [name, *others]
        out = F.when(predicate.isin(group), F.array_union(out, F.lit(group))).otherwise(out)
    return out


def without_synonyms(batch: DataFrame, store: DataFrame) -> DataFrame:
    """Rows of ``batch`` whose subject and object no stored fact joins by an equivalent predicate."""
    key = [F.lower(F.trim("subject")).alias("__s"), F.lower(F.trim("object")).alias("__o")]
    have = store.select(*key, F.explode(expand_predicate(F.lower("predicate"))).alias("__p")).distinct()
    rows = batch.select("*", *key, expand_predicate(F.lower("predicate")).alias("__ps"))
    hit = rows.select("id", "__s", "__o", F.explode("__ps").alias("__p")).join(have, ["__s", "__o", "__p"], "left_semi").select("id").distinct()
    return rows.join(hit, "id", "left_anti").drop("__s", "__o", "__ps")


def conflict_candidates(batch: DataFrame, store: DataFrame, now: Column) -> DataFrame:
    """(batch_id, store_id): equal predicate, and equal entity ids or equal lower-case names.

    The alternative is two equi joins, united; an OR in one join would compare all pairs.
    """
    s = store.where(effective_at(now)).select(F.col("id").alias("store_id"), F.col("predicate").alias("p"), F.col("subject_entity_id").alias("se"), F.col("object_entity_id").alias("oe"), F.lower("subject").alias("sn"), F.lower("object").alias("on"))
    by_id = batch.join(s, (F.col("predicate") == F.col("p")) & (F.col("subject_entity_id") == F.col("se")) & (F.col("object_entity_id") == F.col("oe")))
    by_name = batch.join(s, (F.col("predicate") == F.col("p")) & (F.lower("subject") == F.col("sn")) & (F.lower("object") == F.col("on")))
    return by_id.select(F.col("id").alias("batch_id"), "store_id").union(by_name.select("id", "store_id")).distinct()


def batch_hash(facts: DataFrame, keys: list[str]) -> DataFrame:
    """SHA-256 of the canonical JSON of a batch's facts, sorted by triple."""
    return facts.groupBy(*keys).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct(*TRIPLE)))), 256).alias("batch_hash"))


#: Names by which a speaker means itself.
FIRST_PERSON = ["i", "me", "my", "mine", "myself", "user"]


def _substrings(c: Column, lengths: Column) -> Column:
    """Distinct substrings of the given lengths."""
    fit = F.filter(lengths, lambda n: n <= F.length(c))
    return F.array_distinct(F.flatten(F.transform(fit, lambda n: F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n)))))


def resolve_names(facts: DataFrame, entities: DataFrame, column: str, out: str, scope: list[str] | None = None) -> DataFrame:
    """Entity of the name in ``column``: exact, contains, contained (3+ characters), normalised (2+).

    ``entities`` has id, name, entity_type and position, which breaks ties; names meet
    entities of the same ``scope`` only. A first-person name takes the first Person.

    Every rule is an equi join: a name that contains another has it among its own
    substrings of that length, and only lengths that occur are cut. Of the entities that
    share a key the first goes on, so a key has one row however many names share it.
    """
    scope = scope or []
    e = entities.select(*scope, F.col("id").alias("__e"), F.lower(F.trim("name")).alias("__name"), F.col("entity_type").alias("__type"), F.col("position").alias("__at"))
    names = facts.select(*scope, column).where(F.col(column).isNotNull()).distinct().withColumn("__q", F.lower(F.trim(F.col(column))))
    me = F.col("__q").isin(FIRST_PERSON)
    other = names.where(~me)
    asked = other.where(F.length("__q") >= 3)
    key = [*scope, "__g"]
    first = F.min(F.struct("__at", "__e")).alias("__m")
    named = e.groupBy(*scope, "__name").agg(first)  # the first entity of each name
    lengths = lambda df, c: F.broadcast(df.agg(F.collect_set(F.length(c)).alias("__lengths")))
    cut = lambda df, c, by: df.crossJoin(by).select("*", F.explode(_substrings(F.col(c), F.col("__lengths"))).alias("__g"))
    long_named = named.where(F.length("__name") >= 3)
    parts = [
        names.where(me).withColumn("__g", F.lit("me")).join(e.where("__type = 'Person'").groupBy(*scope).agg(first).withColumn("__g", F.lit("me")), key).withColumn("__r", F.lit(0)),
        other.withColumn("__g", F.col("__q")).join(named.withColumnRenamed("__name", "__g"), key).withColumn("__r", F.lit(1)),
        cut(asked, "__q", lengths(long_named, "__name")).join(long_named.withColumnRenamed("__name", "__g"), key).withColumn("__r", F.lit(2)),
        asked.withColumn("__g", F.col("__q")).join(cut(named, "__name", lengths(asked, "__q")).groupBy(*key).agg(F.min("__m").alias("__m")), key).withColumn("__r", F.lit(3)),
        other.withColumn("__g", identity_term(F.col("__q"))).where(F.length("__g") >= 2).join(named.withColumn("__g", identity_term(F.col("__name"))).groupBy(*key).agg(F.min("__m").alias("__m")), key).withColumn("__r", F.lit(4)),
    ]
    parts = [p.select(*scope, column, "__r", "__m") for p in parts]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    matched = found.groupBy(*scope, column).agg(F.min(F.struct("__r", "__m")).alias("m")).select(*scope, column, F.col("m.__m.__e").alias(out))
    return facts.join(matched, [*scope, column], "left")
