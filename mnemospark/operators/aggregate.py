"""Counts, statistics and summaries. Each is one grouping per input, then equi joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The stages of enrichment and their bits.
STAGES = {"classification": 0, "entities": 1, "facts": 2, "structured": 3, "embedding": 4, "linking": 5}
LATER_STAGES = {"observations": 6, "blob_text": 7, "llm_invalidation": 8}
ALL = 63


def daily_counts(left: DataFrame, right: DataFrame, ts: str, since: Column, names: tuple[str, str]) -> DataFrame:
    """Two daily series since an instant, zipped on the day, missing days 0, newest first."""
    series = [df.where(F.col(ts) >= since).groupBy(F.date_trunc("day", F.col(ts)).alias("day")).agg(F.count(F.lit(1)).alias(n)) for df, n in zip((left, right), names, strict=True)]
    return series[0].join(series[1], "day", "full").select(F.date_format("day", "yyyy-MM-dd").alias("day"), *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names]).orderBy(F.desc("day"))


def enrichment_dashboard(episodes: DataFrame, recent: Column) -> DataFrame:
    """One pass: total, recent, in progress, pending, complete, and the share complete in percent."""
    status = F.col("enrichment_status")
    total = F.count(F.lit(1))
    return episodes.agg(
        total.alias("total"), F.count_if(F.col("created_at") >= recent).alias("recent"), F.count_if((status != ALL) & (status != 0)).alias("in_progress"),
        F.count_if(status == 0).alias("pending"), F.count_if(status == ALL).alias("complete"),
        F.when(total > 0, F.round(100 * F.count_if(status == ALL) / total, 1)).otherwise(0.0).alias("pct_complete"),
    )


def session_stats(episodes: DataFrame, facts: DataFrame) -> DataFrame:
    """Messages, facts, last message and pending episodes of every session."""
    per_episode = facts.groupBy(F.col("source_episode_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return episodes.join(per_episode, "id", "left").groupBy("session_id").agg(
        F.count(F.lit(1)).alias("message_count"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("fact_count"),
        F.max("created_at").alias("last_message_at"), F.count_if(F.col("enrichment_status") != ALL).alias("pending"),
    )


def user_stats(users: DataFrame, messages: DataFrame, facts: DataFrame, sessions: DataFrame, key: str) -> DataFrame:
    """Counts for every user; users without rows get 0."""
    out = users.select(key).distinct()
    for df, name in ((messages, "messages"), (facts, "facts"), (sessions, "sessions")):
        out = out.join(df.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left")
    return out.select(key, *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("messages", "facts", "sessions")])


def top_pairs(df: DataFrame, keys: list[str], pair: list[str], n: int = 5) -> DataFrame:
    """The n commonest value pairs of each key."""
    counts = df.groupBy(*keys, *pair).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), *pair)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the first by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def next_sequence(episodes: DataFrame, live_only: bool = False) -> DataFrame:
    rows = episodes.where(~F.col("is_deleted")) if live_only else episodes
    return rows.groupBy("session_id").agg((F.coalesce(F.max("sequence_number"), F.lit(-1)) + 1).alias("next_sequence"))


def tenant_counts(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def member_counts(projects: DataFrame, members: DataFrame) -> DataFrame:
    counts = members.groupBy("project_id").agg(F.count(F.lit(1)).alias("members"))
    return projects.join(counts, "project_id", "left").withColumn("members", F.coalesce("members", F.lit(0)))


def usage_rollup(usage: DataFrame, keys: list[str]) -> DataFrame:
    """Token and cost sums; total tokens are computed, not stored."""
    return usage.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens")).groupBy(*keys).agg(
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("total_tokens").alias("total_tokens"), F.sum("cost_estimate").alias("cost_estimate"),
    )


def recall_at(results: DataFrame, k: int) -> DataFrame:
    """Share of questions of each category whose terms all occur in one of the first k results.

    ``results`` has question_id, category, rank, content and terms.
    """
    hit = F.forall("terms", lambda t: F.contains(F.lower("content"), F.lower(t))) & (F.col("rank") <= k)
    per_question = results.groupBy("question_id", "category").agg(F.max(hit.cast("int")).alias("hit"))
    return per_question.groupBy("category").agg(F.avg("hit").alias("recall"), F.count(F.lit(1)).alias("questions"))


def quick_actions(counts: DataFrame) -> DataFrame:
    """Suggested next steps from the counts of projects, members and episodes."""
    steps = F.array(F.when(F.col("projects") == 0, "create_project"), F.when(F.col("members") <= 1, "invite_member"), F.when(F.col("episodes") == 0, "send_message"))
    return counts.withColumn("actions", F.filter(steps, lambda s: s.isNotNull()))


def metric_quantiles(samples: DataFrame, ts: str, value: str, quantiles: list[float], minutes: int = 5) -> DataFrame:
    """Rate a second and exact quantiles of samples in tumbling windows."""
    w = F.window(F.col(ts).cast("timestamp"), f"{minutes} minutes")
    return samples.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / (60.0 * minutes)).alias("rate"), F.percentile(value, F.lit(quantiles)).alias("q")).select(F.col("w.start").alias("start"), "n", "rate", *[F.element_at("q", i + 1).alias(f"p{round(100 * x)}") for i, x in enumerate(quantiles)])


def missing_stages(episodes: DataFrame, idle_before: Column, limit: int = 100) -> DataFrame:
    """(id, stage) to run again: the oldest incomplete episodes that were idle since an instant."""
    stale = episodes.where((F.col("enrichment_status") != ALL) & (F.col("created_at") < idle_before)).orderBy("created_at", "id").limit(limit)
    bits = F.array(*[F.struct(F.lit(n).alias("stage"), F.lit(1 << b).alias("bit")) for n, b in STAGES.items()])
    return stale.select("id", "enrichment_status", F.explode(bits).alias("s")).where(F.col("enrichment_status").bitwiseAND(F.col("s.bit")) == 0).select("id", "s.stage")


def classified_episodes(classifications: DataFrame, episodes: DataFrame) -> DataFrame:
    return classifications.join(episodes.select(F.col("id").alias("episode_id"), "content", "sequence_number"), "episode_id").orderBy("sequence_number", "episode_id")


def user_profile(facts: DataFrame, links: DataFrame, entities: DataFrame, moods: DataFrame, key: str = "user_id", newest: int = 100, names: int = 50) -> DataFrame:
    """Inputs of a user's profile: newest facts, distinct entity names, commonest moods."""
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last("valid_from"), "id")
    recent = facts.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= newest).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__n", "content"))).alias("facts"))
    named = links.join(entities.select(F.col("id").alias("entity_id"), "name"), "entity_id").select(key, "name").distinct()
    n = Window.partitionBy(key).orderBy("name")
    some = named.withColumn("__n", F.row_number().over(n)).where(F.col("__n") <= names).groupBy(key).agg(F.array_sort(F.collect_list("name")).alias("entities"))
    mood = top_pairs(moods, [key], ["intent", "emotion"]).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "intent", "emotion", "n"))).alias("moods"))
    return recent.join(some, key, "full").join(mood, key, "full")


def extractions_of(extractions: DataFrame, episodes: DataFrame) -> DataFrame:
    """Structured extractions with the session of their episode."""
    return extractions.join(episodes.select(F.col("id").alias("episode_id"), "session_id"), "episode_id")


def extraction_counts(extractions: DataFrame) -> DataFrame:
    return extractions.groupBy("session_id").agg(F.count(F.lit(1)).alias("extractions"), F.countDistinct("episode_id").alias("episodes"))


def identity_counts(batch: DataFrame, identity: Column) -> DataFrame:
    """Every row with the number of rows of its identity."""
    return batch.withColumn("__k", identity).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("__k"))).drop("__k")
