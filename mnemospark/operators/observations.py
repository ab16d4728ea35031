"""Pattern mining: co-occurrence, temporal gaps, behaviour.

Each pattern is one set-based plan over all entities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.temporal import effective_at, hours_between
from .graph import co_occurrence, edge_ids_between

#: Classes of temporal patterns, their order, confidence and wording.
CLASSES = {
    "periodic": (0.85, "regular intervals"),
    "widening": (0.75, "increasing gaps"),
    "narrowing": (0.70, "decreasing gaps"),
    "burst": (0.65, "clustered appearances with long gaps between"),
    "irregular": (0.40, "irregular intervals"),
}


def co_occurrence_patterns(links: DataFrame, edges: DataFrame | None = None, least: int = 3) -> DataFrame:
    """a, b, co_count, total_episodes, confidence and, with ``edges``, the supporting edge ids."""
    total = links.agg(F.countDistinct("episode_id").alias("total_episodes")).where("total_episodes > 0")
    out = co_occurrence(links, least).crossJoin(F.broadcast(total))  # one row
    out = out.withColumn("confidence", F.round(F.least(F.col("co_count") / 20, F.lit(1.0)), 6))
    return out if edges is None else out.join(edge_ids_between(edges), ["a", "b"], "left")


def gaps(events: DataFrame, entity: str, ts: str, tie: str) -> DataFrame:
    """Hours between consecutive appearances, with their position."""
    w = Window.partitionBy(entity).orderBy(ts, tie)
    return events.select(entity, ts, tie, hours_between(F.lag(ts).over(w), F.col(ts)).alias("gap"), F.row_number().over(w).alias("n"))


def temporal_patterns(events: DataFrame, entity: str, ts: str, tie: str, least: int = 3) -> DataFrame:
    """Class, mean, deviation and variation of the gaps of at least an hour, and the span in days.

    Two windows and a grouping over one partitioning: one shuffle.
    """
    g = gaps(events, entity, ts, tie).withColumn("big", F.when(F.col("gap") >= 1, F.col("gap")))
    # step between consecutive significant gaps
    order = Window.partitionBy(entity).orderBy("n")
    before = F.last("big", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    g = g.withColumn("before", F.when(F.col("big").isNotNull(), before))
    steps = F.count_if(F.col("before").isNotNull())
    rising, falling = F.count_if(F.col("big") > F.col("before")), F.count_if(F.col("big") < F.col("before"))
    s = g.groupBy(entity).agg(
        F.count(F.lit(1)).alias("appearance_count"), F.count("big").alias("gap_count"), F.avg("big").alias("mean"), F.stddev_pop("big").alias("sd"), F.min("big").alias("min_gap"), F.max("big").alias("max_gap"),
        steps.alias("steps"), rising.alias("rising"), falling.alias("falling"), F.count("gap").alias("all_gaps"), F.count_if(F.col("gap") <= 6).alias("short"), F.count_if(F.col("gap") > 24).alias("long"),
        (hours_between(F.min(ts), F.max(ts)) / 24).alias("span"),
    ).where((F.col("appearance_count") >= least) & (F.col("gap_count") > 0))
    sd = F.when(F.col("gap_count") >= 2, F.col("sd")).otherwise(0.0)
    cv = F.when(F.col("mean") > 0, sd / F.col("mean")).otherwise(0.0)
    monotonic = lambda c: (F.col("gap_count") >= 3) & (F.col(c) / F.col("steps") >= 0.6)
    kind = (
        F.when((cv < 0.25) & (F.col("gap_count") >= 2), "periodic").when(monotonic("rising"), "widening").when(monotonic("falling"), "narrowing")
        .when((F.col("all_gaps") >= 3) & (F.col("short") >= 2) & (F.col("long") >= 1), "burst").otherwise("irregular")
    )
    out = s.withColumn("pattern_type", kind).withColumn("cv", cv).withColumn("sd", sd)
    confidence = F.lit(None).cast("double")
    for name, (c, _) in CLASSES.items():
        confidence = F.when(F.col("pattern_type") == name, c).otherwise(confidence)
    return out.select(
        entity, "pattern_type", "appearance_count", "gap_count", F.round("mean", 2).alias("mean_gap_hours"), F.round("sd", 2).alias("std_gap_hours"),
        F.round("min_gap", 2).alias("min_gap_hours"), F.round("max_gap", 2).alias("max_gap_hours"), F.round("cv", 4).alias("cv"), F.round("span", 1).alias("span_days"), confidence.alias("confidence"),
    )


def predicate_counts(facts: DataFrame, now: Column, least: int = 2) -> DataFrame:
    """subject, predicate, n for predicates of ``least`` facts or more, with

    surviving_predicates, the number of predicates left for the subject, and total_facts.
    """
    all_counts = facts.where(effective_at(now)).groupBy("subject", "predicate").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("subject")
    totals = all_counts.withColumn("total_facts", F.sum("n").over(w))
    return totals.where(F.col("n") >= least).withColumn("surviving_predicates", F.count(F.lit(1)).over(w))


def behaviour_patterns(facts: DataFrame, now: Column, least: int = 2, corrected: bool = False) -> DataFrame:
    """Frequent predicates of each subject, commonest first, and the confidence.

    The total is the number of surviving predicates; ``corrected`` takes that of the facts.
    """
    counts = predicate_counts(facts, now, least)
    total = F.col("total_facts" if corrected else "surviving_predicates")
    grouped = counts.groupBy("subject").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "predicate"))).alias("p"), F.max(total).alias("total"))
    top = -F.col("p")[0]["m"]
    return grouped.select(
        "subject", F.col("p")[0]["predicate"].alias("top_predicate"), top.alias("top_count"), "total",
        F.array_join(F.transform("p", lambda x: F.concat(x["predicate"], F.lit("("), (-x["m"]).cast("string"), F.lit(")"))), ", ").alias("predicates"),
        F.round(F.least(top / F.col("total") * 1.5, F.lit(0.95)), 2).alias("confidence"),
    )


# The wording of the three sentences.


def describe_co_occurrence(a: Column, b: Column) -> Column:
    share = F.round(F.col("co_count") / F.col("total_episodes") * 100).cast("int")
    return F.format_string("'%s' appears alongside '%s' in %d out of %d episodes (%d%% co-occurrence rate).", a, b, F.col("co_count"), F.col("total_episodes"), share)


def describe_temporal(name: Column) -> Column:
    label = F.col("pattern_type")
    for k, (_, words) in CLASSES.items():
        label = F.when(F.col("pattern_type") == k, words).otherwise(label)
    return F.format_string("'%s' appears at %s (mean gap: %.1fh, span: %.1fd, %d appearances).", name, label, F.col("mean_gap_hours"), F.col("span_days"), F.col("appearance_count"))


def describe_behaviour(name: Column) -> Column:
    rest = F.array_join(F.slice(F.split("predicates", ", "), 2, 3), ", ")
    return F.format_string("'%s' most frequently exhibits the predicate '%s' (%d out of %d facts). Additional predicates: %s.", name, F.col("top_predicate"), F.col("top_count"), F.col("total"), rest)


def symmetric(pairs: DataFrame) -> DataFrame:
    """Rows of both orders of a pair, as they are stored."""
    return pairs.select(F.col("a").alias("subject_entity_id"), F.col("b").alias("related_entity_id"), "co_count", "confidence").union(pairs.select("b", "a", "co_count", "confidence"))


def observations(links: DataFrame, events: DataFrame, facts: DataFrame, now: Column, entity: str, ts: str, tie: str) -> DataFrame:
    """All observations of a project as rows of one table."""
    co = symmetric(co_occurrence_patterns(links)).select(F.col("subject_entity_id").cast("string"), F.lit("co_occurrence").alias("observation_type"), F.col("related_entity_id").cast("string"), "confidence")
    t = temporal_patterns(events, entity, ts, tie).select(F.col(entity).cast("string").alias("subject_entity_id"), F.lit("temporal_pattern").alias("observation_type"), F.lit(None).cast("string").alias("related_entity_id"), "confidence")
    b = behaviour_patterns(facts, now).select(F.col("subject").cast("string").alias("subject_entity_id"), F.lit("behavioral_pattern").alias("observation_type"), F.lit(None).cast("string").alias("related_entity_id"), "confidence")
    return co.unionByName(t).unionByName(b)


def with_names(observations_: DataFrame, entities: DataFrame) -> DataFrame:
    names = entities.select("id", "name")
    return observations_.join(names.select(F.col("id").alias("subject_entity_id"), F.col("name").alias("subject_name")), "subject_entity_id", "left").join(names.select(F.col("id").alias("related_entity_id"), F.col("name").alias("related_name")), "related_entity_id", "left")
