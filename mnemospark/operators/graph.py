"""Property graph: traversal, co-occurrence, communities, merging, expiry.

Edges are (id, source_id, target_id, relationship_type, valid_from, valid_to, invalid_at).
Traversals work level by level: a frontier joins the edges of both orientations on
equality, and nodes seen before drop out, so paths never multiply. Levels and rounds are
written to the folder that executors share, so no plan holds more than one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.temporal import effective_at
from ..functions.text import capitalised_words
from ..sources.staging import staged
from .paging import keyset_page
from .retrieval import most_similar, search_entities, similar_pairs

MAX_DEPTH = 5


#: Entities of an episode from which on its pairs come from a join instead of a set.
LARGE_EPISODE = 1000


def live_edges(edges: DataFrame, as_of: Column | None = None, types: list[str] | None = None) -> DataFrame:
    """Active edges, or those live at an instant (upper bound included); an empty type list matches none."""
    out = edges.where("invalid_at is null") if as_of is None else edges.where(effective_at(as_of, upper_inclusive=True))
    return out if types is None else out.where(F.col("relationship_type").isin(types) if types else F.lit(False))


def both_ways(edges: DataFrame, direction: str = "both") -> DataFrame:
    """(a, b) for every edge, in one orientation or both: an equi join instead of an OR join."""
    out = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    back = edges.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"))
    return {"out": out, "in": back, "both": out.union(back)}[direction]


def bfs(edges: DataFrame, seeds: DataFrame, depth: int = 2, direction: str = "both") -> DataFrame:
    """(id, depth): the least depth of every node within ``depth`` of the ``seeds`` (id)."""
    pairs = staged(both_ways(edges, direction).where("a != b"), "pairs")
    seen = staged(seeds.select("id").distinct().withColumn("depth", F.lit(0)), "level")
    frontier = seen
    for level in range(1, min(depth, MAX_DEPTH) + 1):
        reached = frontier.select(F.col("id").alias("a")).join(pairs, "a").select(F.col("b").alias("id")).distinct()
        frontier = staged(reached.join(seen, "id", "left_anti").withColumn("depth", F.lit(level)), "level")
        seen = seen.unionByName(frontier)
    return seen


def retrieve(entities: DataFrame, edges: DataFrame, query: str, seeds: int = 5, depth: int = 2, limit: int = 50, as_of: Column | None = None, mode: str = "nearest") -> DataFrame:
    """(id, distance): best entity hits and their neighbourhood.

    ``nearest`` takes the least distance from any seed. ``first_seen`` takes the distance
    from the first seed, in search order, that reaches a node.
    """
    hits = search_entities(entities, query, limit=seeds)
    live = live_edges(edges, as_of)
    if mode == "nearest":
        found = bfs(live, hits, depth)
    else:
        order = Window.orderBy(F.desc("score"), "id")  # seeds are few
        pairs = both_ways(live)
        frontier = hits.select("id", F.row_number().over(order).alias("seed")).withColumn("depth", F.lit(0))
        seen = frontier
        for level in range(1, depth + 1):
            step = frontier.join(pairs, frontier.id == pairs.a).select(F.col("b").alias("id"), "seed").distinct()
            frontier = step.join(seen.select("id", "seed"), ["id", "seed"], "left_anti").withColumn("depth", F.lit(level))
            seen = seen.unionByName(frontier)
        found = seen.groupBy("id").agg(F.min(F.struct("seed", "depth")).alias("m")).select("id", F.col("m.depth").alias("depth"))
    return found.select("id", F.col("depth").alias("distance")).orderBy("distance", "id").limit(limit)


def retrieve_many(parts: list[DataFrame], limit: int = 50) -> DataFrame:
    """Hits of several graphs: least distance of each id, nearest first."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("id").agg(F.min("distance").alias("distance")).orderBy("distance", "id").limit(limit)


def co_occurrence(links: DataFrame, least: int = 3) -> DataFrame:
    """(a, b, co_count): entity pairs a < b that share ``least`` or more episodes (episode_id, entity_id).

    Pairs come from one set of each episode, so the links are shuffled once and pair
    counts are combined before their shuffle. Episodes with more than LARGE_EPISODE
    entities make no set: their pairs come from a join, which spills and can be split.
    """
    distinct = links.select("episode_id", "entity_id").distinct()
    sizes = distinct.groupBy("episode_id").agg(F.count(F.lit(1)).alias("n"))
    large = distinct.join(sizes.where(F.col("n") > LARGE_EPISODE).select("episode_id"), "episode_id", "left_semi")
    small = distinct.join(sizes.where((F.col("n") > 1) & (F.col("n") <= LARGE_EPISODE)).select("episode_id"), "episode_id", "left_semi")
    sets = small.groupBy("episode_id").agg(F.array_sort(F.collect_list("entity_id")).alias("e"))
    pairs = sets.select(F.posexplode("e").alias("i", "a"), "e").select("a", F.explode(F.slice("e", F.col("i") + 2, F.size("e"))).alias("b"))
    joined = large.withColumnRenamed("entity_id", "a").join(large.withColumnRenamed("entity_id", "b"), "episode_id").where("a < b").select("a", "b")
    return pairs.union(joined).groupBy("a", "b").agg(F.count(F.lit(1)).alias("co_count")).where(F.col("co_count") >= least)


def linked_episodes(links: DataFrame) -> DataFrame:
    return links.agg(F.countDistinct("episode_id").alias("total"))


def edge_ids_between(edges: DataFrame) -> DataFrame:
    """(a, b, ids): edge ids of every node pair, whatever their direction."""
    key = [F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")]
    return edges.groupBy(*key).agg(F.array_sort(F.collect_list("id")).alias("ids"))


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 3) -> DataFrame:
    """(id, label): synchronous rounds; a node takes the commonest label of its neighbours and itself, least on ties.

    Counting is a grouping by (node, label), so a hub's neighbours never meet in one list.
    """
    n = nodes.select("id").distinct()
    pairs = both_ways(edges).where("a != b").distinct()
    pairs = pairs.join(n.withColumnRenamed("id", "a"), "a", "left_semi").join(n.withColumnRenamed("id", "b"), "b", "left_semi")
    around = staged(pairs.select(F.col("a").alias("id"), F.col("b").alias("near")).union(n.select("id", F.col("id").alias("near"))), "around")
    labels = n.withColumn("label", F.col("id"))
    for _ in range(rounds):
        votes = around.join(labels.withColumnRenamed("id", "near"), "near").groupBy("id", "label").agg(F.count(F.lit(1)).alias("n"))
        labels = staged(votes.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("m")).select("id", F.col("m.label").alias("label")), "labels")
    return labels


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 3, least_size: int = 2) -> DataFrame:
    """Communities of two or more: label, member_count, name from the first three members, summary."""
    named = label_propagation(nodes, edges, rounds).join(nodes.select("id", "name"), "id")
    first = Window.partitionBy("label").orderBy("name", "id")
    heads = named.withColumn("__n", F.row_number().over(first)).where("__n <= 3").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("__n", "name"))).alias("h"))
    sizes = named.groupBy("label").agg(F.count(F.lit(1)).alias("member_count")).where(F.col("member_count") >= least_size)
    name = F.array_join(F.transform("h", lambda x: x["name"]), ", ")
    return sizes.join(heads, "label").select("label", "member_count", name.alias("name"), F.concat(F.lit("Community of "), F.col("member_count").cast("string"), F.lit(" entities: "), name).alias("summary"))


def member_edges(labels: DataFrame, communities_: DataFrame) -> DataFrame:
    """member_of edges from each entity to its community."""
    return labels.join(communities_.select("label"), "label", "left_semi").select(F.col("id").alias("source_id"), F.concat(F.lit("community:"), F.col("label").cast("string")).alias("target_id"), F.lit("member_of").alias("relationship_type"))


def duplicate_clusters(entities: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(id, cluster): exact groups of lower-case trimmed names, then greedy fuzzy groups in name order.

    ``cluster`` is the id of the group's first entity. Greedy: a name joins the first
    earlier head that is similar enough; heads settle in rounds, each a join.
    """
    keyed = entities.select("id", "name", F.lower(F.trim("name")).alias("k"))
    exact = keyed.groupBy("k").agg(F.min("id").alias("head"))
    pairs = similar_pairs(exact.select(F.col("head").alias("id"), F.col("k").alias("name")), threshold)
    near = pairs.join(exact.select(F.col("head").alias("a"), F.col("k").alias("ka")), "a").join(exact.select(F.col("head").alias("b"), F.col("k").alias("kb")), "b")
    forward = near.select(F.when(F.col("ka") < F.col("kb"), F.col("a")).otherwise(F.col("b")).alias("first"), F.least("ka", "kb").alias("kf"), F.when(F.col("ka") < F.col("kb"), F.col("b")).otherwise(F.col("a")).alias("second"))
    state = exact.select(F.col("head").alias("id"), F.lit(None).cast("string").alias("of"), F.lit(False).alias("settled"))
    forward = staged(forward, "forward")
    while True:
        # settled heads claim; a node with no unsettled or head predecessor becomes a head
        pred = forward.join(state.select(F.col("id").alias("first"), F.col("of").alias("fo"), F.col("settled").alias("fs")), "first")
        seen = pred.groupBy("second").agg(F.min(F.when(F.col("fs") & F.col("fo").isNull(), F.struct("kf", "first"))).alias("claim"), F.min(F.when(~F.col("fs"), F.col("kf"))).alias("open"))
        joined = state.join(seen, state.id == F.col("second"), "left")
        ready = F.col("open").isNull() | (F.col("claim").isNotNull() & (F.col("claim.kf") < F.col("open")))
        of = F.when(F.col("settled"), F.col("of")).when(ready, F.col("claim.first").cast("string"))
        state = staged(joined.select("id", of.alias("of"), (F.col("settled") | ready).alias("settled")), "state")
        if state.where(~F.col("settled")).isEmpty():
            break
    heads = exact.join(state.select(F.col("id").alias("head"), "of"), "head").select("k", F.coalesce(F.col("of"), F.col("head").cast("string")).alias("cluster"))
    return keyed.join(heads, "k").select("id", "cluster")


def canonical(entities: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, canonical_id): the entity created last."""
    return clusters.join(entities.select("id", "created_at"), "id").groupBy("cluster").agg(F.max_by("id", F.struct("created_at", "id")).alias("canonical_id"))


def merge_entities(entities: DataFrame, edges: DataFrame, mapping: DataFrame, drop_self_loops: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rewire active edges by ``mapping`` (merged_id, canonical_id) and keep one of each (source, target, type).

    Returns entities with is_merged, the edges, and counts. Self loops stay unless asked otherwise.
    """
    m = mapping.select("merged_id", "canonical_id")
    active = edges.where("invalid_at is null")
    src = m.select(F.col("merged_id").alias("source_id"), F.col("canonical_id").alias("__s"))
    dst = m.select(F.col("merged_id").alias("target_id"), F.col("canonical_id").alias("__t"))
    rewired = active.join(src, "source_id", "left").join(dst, "target_id", "left").withColumn("__moved", F.col("__s").isNotNull() | F.col("__t").isNotNull())
    rewired = rewired.withColumn("source_id", F.coalesce("__s", "source_id")).withColumn("target_id", F.coalesce("__t", "target_id")).drop("__s", "__t")
    if drop_self_loops:
        rewired = rewired.where(~F.col("__moved") | (F.col("source_id") != F.col("target_id")))
    w = Window.partitionBy("source_id", "target_id", "relationship_type").orderBy("id")
    numbered = rewired.withColumn("__n", F.row_number().over(w))
    counts = numbered.agg(F.count_if("__moved").alias("rewired"), F.count_if(F.col("__n") > 1).alias("deduplicated"))
    kept = numbered.where("__n = 1").select(*edges.columns).unionByName(edges.where("invalid_at is not null"))
    flagged = entities.join(m.select(F.col("merged_id").alias("id"), F.lit(True).alias("__m")).distinct(), "id", "left").withColumn("is_merged", F.coalesce("__m", F.lit(False))).drop("__m")
    return flagged, kept, counts


def expire(edges: DataFrame, commands: DataFrame, at: Column) -> DataFrame:
    """Stamp invalid_at on active edges named by (source_id, target_id, relationship_type)."""
    keys = ["source_id", "target_id", "relationship_type"]
    hit = edges.join(commands.select(*keys).distinct().withColumn("__hit", F.lit(True)), keys, "left")
    return hit.withColumn("invalid_at", F.when(F.col("__hit") & F.col("invalid_at").isNull(), at).otherwise(F.col("invalid_at"))).drop("__hit").select(*edges.columns)


def expiry_commands(events: DataFrame) -> DataFrame:
    """Edge keys to expire from lineage events (kind, old key struct, new key struct).

    Facts without a key give none; a successor with the same key keeps the edge; a
    retraction always expires it.
    """
    has = F.col("old.source_id").isNotNull() & F.col("old.target_id").isNotNull() & F.col("old.relationship_type").isNotNull()
    same = F.col("old").eqNullSafe(F.col("new"))
    return events.where(has & ((F.col("kind") == "retracted") | ~same)).select("old.*").distinct()


def orphans(edges: DataFrame, facts: DataFrame, now: Column) -> DataFrame:
    """Active edges that no live fact sustains; a fact that starts in the future sustains too."""
    sustained = facts.where((F.col("invalid_at").isNull() | (F.col("invalid_at") > now)) & (F.col("valid_to").isNull() | (F.col("valid_to") > now)))
    keys = sustained.select(F.col("subject_entity_id").alias("source_id"), F.col("predicate").alias("relationship_type"), F.col("object_entity_id").alias("target_id"))
    return edges.where("invalid_at is null").join(keys, ["source_id", "relationship_type", "target_id"], "left_anti")


def reconcile(edges: DataFrame, facts: DataFrame, now: Column) -> DataFrame:
    return expire(edges, orphans(edges, facts, now), now)


def listing(edges: DataFrame, limit: int, last: list[object] | None = None) -> DataFrame:
    """Active edges, newest first, a page at a time: the cursor is the (created_at, id) of the last row seen."""
    return keyset_page(live_edges(edges), [("created_at", False), ("id", False)], limit, last)


def all_active(edges: DataFrame) -> DataFrame:
    return live_edges(edges).orderBy(F.desc("created_at"), "id")


def session_entities(episodes: DataFrame, links: DataFrame, entities: DataFrame, memberships: DataFrame | None = None) -> DataFrame:
    """Distinct entities mentioned in each session, and the communities that they belong to."""
    mentioned = links.join(episodes.select(F.col("id").alias("episode_id"), "session_id"), "episode_id").select("session_id", F.col("entity_id").alias("id")).distinct()
    if memberships is not None:
        over = mentioned.join(memberships.select(F.col("source_id").alias("id"), F.col("target_id").alias("__c")), "id").select("session_id", F.col("__c").alias("id"))
        mentioned = mentioned.union(over).distinct()
    return mentioned.join(entities.select("id", "name", "entity_type"), "id")


def entity_with_edges(entities: DataFrame, edges: DataFrame) -> DataFrame:
    pairs = edges.select(F.col("source_id").alias("id"), F.struct("relationship_type", F.col("target_id").alias("other"), F.lit("out").alias("way")).alias("e")).union(edges.select(F.col("target_id").alias("id"), F.struct("relationship_type", F.col("source_id").alias("other"), F.lit("in").alias("way")).alias("e")))
    return entities.join(pairs.groupBy("id").agg(F.array_sort(F.collect_list("e")).alias("edges")), "id", "left")


def edges_of(edges: DataFrame, subjects: DataFrame, per_subject: int) -> DataFrame:
    """Newest edges of many subjects, a limit for each, every edge once."""
    both = edges.select("*", F.col("source_id").alias("subject")).union(edges.select("*", F.col("target_id").alias("subject")))
    pairs = both.join(subjects.select(F.col("id").alias("subject")).distinct(), "subject", "left_semi")
    w = Window.partitionBy("subject").orderBy(F.desc("created_at"), "id")
    return pairs.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= per_subject).drop("__n", "subject").dropDuplicates(["id"])


def link_mentions(episodes: DataFrame, entities: DataFrame, threshold: float = 0.3, per_word: int = 5) -> DataFrame:
    """(episode_id, entity_id): capitalised words to their most similar entity names, five a word.

    Distinct words meet the names through groups of their rarer trigrams, an equi join.
    """
    words = episodes.select(F.col("id").alias("episode_id"), F.explode(F.array_distinct(capitalised_words(F.col("content")))).alias("word")).where("word != ''")
    best = most_similar(words.select("word").distinct(), entities, threshold, per_word)
    return words.hint("merge").join(best.select("word", F.col("id").alias("entity_id")), "word").select("episode_id", "entity_id").distinct()


def appearances(links: DataFrame, episodes: DataFrame) -> DataFrame:
    """(entity_id, ts) of the live episodes that mention an entity."""
    return links.join(episodes.select(F.col("id").alias("episode_id"), F.col("created_at").alias("ts")), "episode_id").select("entity_id", "ts")
