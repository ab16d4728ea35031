"""Queries of operators that the other modules use inside larger ones, and of those without a larger one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import pii
from ..functions import text as tx
from ..functions.temporal import effective_at
from ..operators import aggregate, effects, facts, graph, ingest, observations, paging, retrieval, upsert
from ..operators.store import GraphStore
from ..sources import tables
from ..streaming import jobs
from .registry import query, text, ts
from .retrieval import BM25, GAPS, LEXICAL, TOKENS
from .store import ENTITIES
from .temporal import AS_OF, EDGES, EPISODES, FACTS, LIVE

SHOW = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"


# scans and lookups


@query("SELECT id, predicate FROM facts WHERE id = 42 AND subject = (SELECT user_id FROM events WHERE event_id = 42)", (FACTS,))
def s2_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    f = tables.facts(spark, d).withColumn("organization_id", F.col("subject"))
    org = f.where("id = 42").select("organization_id").first()
    return tables.by_ids(tables.tenant_scope(f, organization_id=org[0] if org else -1), [42]).select("id", "predicate")


@query(f"SELECT id, source_id, target_id, {SHOW.format('created_at')} FROM (SELECT *, valid_from AS created_at FROM edges WHERE confidence > 0.5)", (EDGES,))
def s5_active_relationships(spark: SparkSession, d: str) -> DataFrame:
    e = tables.temporal_edges(spark, d).withColumn("created_at", F.col("valid_from")).withColumn("invalid_at", F.when(F.col("confidence") <= 0.5, F.col("valid_to")))
    return graph.all_active(e).select("id", "source_id", "target_id", text("created_at"))


@query("SELECT event_id, b.job FROM events JOIN (SELECT user_id, event_type, min(event_id) AS job FROM events WHERE value > 50 GROUP BY ALL) b USING (user_id, event_type)")
def s14_prior_jobs(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "events").select("event_id", "value", F.lit(1).alias("project_id"), F.col("user_id").alias("session_id"), F.col("event_type").alias("content_hash"))
    ledger = e.where("value > 50").groupBy("project_id", "session_id", "content_hash").agg(F.min("event_id").alias("job"))
    return ingest.prior_jobs(e, ledger).select("event_id", "job")


def _fact_rows(spark: SparkSession, d: str) -> DataFrame:
    """Events as unresolved facts of one organization, open at both ends."""
    e = tables.read(spark, d, "events")
    none = F.lit(None).cast("string")
    return e.select(
        F.lit(1).alias("organization_id"), F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("subject"), F.col("event_type").alias("predicate"), F.lit("it").alias("object"),
        F.floor(F.col("value") / 10).cast("string").alias("content"), none.alias("subject_entity_id"), none.alias("object_entity_id"), F.col("ts").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"),
        F.lit(None).cast("timestamp_ntz").alias("invalid_at"), "value",
    )


@query(
    """SELECT id, content, strftime(valid_to, '%Y-%m-%d %H:%M:%S') AS valid_to FROM (SELECT id, content, CASE WHEN lead(id) OVER (PARTITION BY user_id, event_type ORDER BY id) IS NOT NULL THEN TIMESTAMP '2024-03-01 00:00:00' END AS valid_to
    FROM (SELECT user_id, event_type, CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) AS content, min(event_id) AS id FROM events GROUP BY ALL))"""
)
def s15_batch_insert(spark: SparkSession, d: str) -> DataFrame:
    """Into an empty store: exact duplicates go, a later content of an identity closes the earlier."""
    rows = _fact_rows(spark, d).drop("value")
    _, inserted, _ = facts.ingest(rows.limit(0), rows, ts("2024-03-01 00:00:00"))
    return inserted.select("id", "content", text("valid_to"))


@query(
    """SELECT old_id, new_id FROM (SELECT s.id AS old_id, min(b.id) AS new_id FROM (SELECT * FROM f WHERE value > 60 AND newest) s JOIN (SELECT user_id, event_type, content, min(id) AS id FROM f WHERE value <= 60 GROUP BY ALL) b USING (user_id, event_type)
    WHERE b.content <> s.content GROUP BY s.id)""",
    ("f AS (SELECT event_id AS id, user_id, event_type, CAST(floor(value / 10) AS BIGINT) AS content, value, value > 60 AND row_number() OVER (PARTITION BY user_id, event_type, value > 60 ORDER BY event_id DESC) = 1 AS newest FROM events)",),
)
def s35_lineage_append(spark: SparkSession, d: str) -> DataFrame:
    """Which stored facts the batch closes, and by which of its facts."""
    rows = _fact_rows(spark, d)
    w = Window.partitionBy("subject", "predicate").orderBy(F.desc("id"))
    store = rows.where("value > 60").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "value")
    _, _, events = facts.ingest(store, rows.where("value <= 60").drop("value"), ts("2024-03-01 00:00:00"))
    return events.join(store.select(F.col("id").alias("old_id")), "old_id", "left_semi").select("old_id", "new_id")


@query("SELECT id, coalesce(keyed, 0) AS keyed FROM (SELECT event_id AS id, CASE WHEN value > 50 THEN user_id * 100 + CAST(floor(value / 10) AS BIGINT) END AS keyed FROM events)")
def t2_identity_rule(spark: SparkSession, d: str) -> DataFrame:
    """Resolved pairs are compared by their ids: facts of one identity get its least number."""
    e = tables.read(spark, d, "events")
    both = F.col("value") > 50
    s, o = F.when(both, F.col("user_id").cast("string")), F.when(both, F.floor(F.col("value") / 10).cast("string"))
    rows = e.select("event_id", "user_id", "value", F.lit("A!").alias("subject"), F.lit("p").alias("predicate"), F.lit("b").alias("object"), s.alias("s"), o.alias("o"))
    key = F.split(facts.identity(F.col("s"), F.col("o")), "\u0001")
    number = F.when(key[0] == "e", key[1].cast("long") * 100 + key[3].cast("long")).when((key[0] == "n") & (key[1] == "a"), F.lit(0).cast("long"))
    return rows.select(F.col("event_id").alias("id"), number.alias("keyed"))


@query("SELECT id, strftime(CASE WHEN id % 5 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' ELSE valid_to END, '%Y-%m-%d %H:%M:%S') AS valid_to FROM facts", (FACTS,))
def s17_update_by_id(spark: SparkSession, d: str) -> DataFrame:
    f = tables.facts(spark, d)
    return upsert.apply_updates(f, f.where("id % 5 = 0").select("id", ts("2024-02-01 00:00:00").alias("valid_to")), "id", ["valid_to"]).select("id", text("valid_to"))


@query("SELECT l_orderkey AS id, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) AS blobs FROM lineitem GROUP BY 1")
def s24_blobs_by_episode(spark: SparkSession, d: str) -> DataFrame:
    li = tables.read(spark, d, "lineitem")
    blobs = li.select(F.col("l_orderkey").alias("episode_id"), F.col("l_linenumber").alias("blob_index"), F.col("l_partkey").cast("string").alias("content_hash"), F.lit("").alias("extracted_text"))
    out = retrieval.with_blobs(li.select(F.col("l_orderkey").alias("id")).distinct(), blobs)
    return out.select("id", F.array_join(F.transform("blobs", lambda b: F.concat_ws(":", b["blob_index"], b["content_hash"])), ",").alias("blobs"))


@query("SELECT CAST(page_id AS VARCHAR) AS path, sha256(html) AS h FROM pages")
def s25_extract_text(spark: SparkSession, d: str) -> DataFrame:
    p = tables.read(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), F.lit("text/html").alias("mime"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"))
    return ingest.extract_text(p).select("path", F.sha2("extracted_text", 256).alias("h"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url END AS extracted_text FROM pages")
def s39_blob_text_stage(spark: SparkSession, d: str) -> DataFrame:
    """Dispatch by MIME type: a parser of its own for one type, none for another."""
    mime = F.when(F.col("page_id") % 2 == 0, "application/x-own").otherwise("image/png")
    p = tables.read(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), mime.alias("mime"), F.encode("url", "UTF-8").alias("content"))
    out = ingest.extract_text(p, {"application/x-own": lambda b: b.decode("utf-8")})
    return out.select(F.col("path").cast("long").alias("page_id"), "extracted_text")


@query("SELECT doc_id, 64 AS dim FROM documents")
def d14_embedding_stage(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.read(spark, d, "documents").select("doc_id", ingest.hash_embedding(F.col("text")).alias("embedding"))
    return docs.select("doc_id", F.size("embedding").alias("dim"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-09 00:00:00'")
def p6_created_range(spark: SparkSession, d: str) -> DataFrame:
    return paging.created_between(tables.read(spark, d, "events"), "ts", ts("2024-01-05 00:00:00"), ts("2024-01-09 00:00:00")).select("event_id")


@query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def p15_column_whitelist(spark: SparkSession, d: str) -> DataFrame:
    n = tables.read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("hidden").alias("secret"), F.row_number().over(Window.orderBy("n_nationkey")).alias("position"))
    doc = retrieval.context_json(entities=n).select(F.explode(F.from_json("json", "struct<entities:array<map<string,string>>>")["entities"]).alias("e"))
    return doc.where("map_contains_key(e, 'secret') = false").select(F.col("e")["id"].cast("int").alias("id"), F.col("e")["name"].alias("name"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type END AS intent, CASE WHEN event_type = 'error' THEN 'negative' END AS valence FROM events")
def p16_label_validation(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "events")
    nothing = F.lit(None).cast("string")
    r = e.select(F.lit(1).alias("organization_id"), F.col("event_id").alias("episode_id"), F.col("event_type").alias("intent"), nothing.alias("emotion"), F.when(F.col("event_type") == "error", "negative").otherwise("odd").alias("valence"), nothing.alias("arousal"), F.lit(0.5).alias("confidence"))
    return upsert.classification_rows(r, r.limit(0), ["click", "view"], []).select(F.col("episode_id").alias("event_id"), "intent", "valence")


@query("SELECT n_nationkey AS id, n_name FROM nation WHERE n_regionkey = 2 ORDER BY n_name DESC")
def p18_list_schemas(spark: SparkSession, d: str) -> DataFrame:
    n = tables.read(spark, d, "nation").withColumnsRenamed({"n_regionkey": "type", "n_nationkey": "id"}).withColumns({"created_at": F.col("n_name"), "is_active": F.lit(True)})
    return paging.list_schemas(n, schema_type=2, active=True).select("id", "n_name")


# joins


@query("SELECT o_orderkey, c_nationkey AS project_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def j1_tenant_join(spark: SparkSession, d: str) -> DataFrame:
    projects = tables.read(spark, d, "customer").withColumn("organization_id", F.col("c_mktsegment"))
    return tables.read(spark, d, "orders").join(tables.tenant_scope(projects, "BUILDING"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("project_id"))


@query("SELECT a.l_orderkey AS episode_id, count(*) AS pairs FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1")
def j6_theta_self_join(spark: SparkSession, d: str) -> DataFrame:
    li = tables.links(spark, d)
    pairs = li.withColumnRenamed("entity_id", "a").join(li.withColumnRenamed("entity_id", "b"), "episode_id").where("a < b")
    return pairs.groupBy("episode_id").agg(F.count(F.lit(1)).alias("pairs"))


@query("SELECT id, count(*) AS n FROM (SELECT source_id AS id, target_id AS other FROM edges UNION ALL SELECT target_id, source_id FROM edges) GROUP BY 1", (EDGES,))
def j7_or_join(spark: SparkSession, d: str) -> DataFrame:
    """Edges of every node in either role: a union of two orientations for an OR join."""
    return graph.both_ways(tables.temporal_edges(spark, d)).groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT o_custkey AS session_id, l_suppkey AS entity_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey")
def j8_session_links(spark: SparkSession, d: str) -> DataFrame:
    episodes = tables.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("session_id"))
    s = tables.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("entity_type"))
    return graph.session_entities(episodes, tables.links(spark, d), s).select("session_id", F.col("id").alias("entity_id"))


@query("SELECT session_id, coalesce(sum(n), 0)::BIGINT AS fact_count FROM (SELECT session_id, (SELECT count(*) FROM facts WHERE source_episode_id = sequence_number) AS n FROM episodes) GROUP BY 1", (FACTS, EPISODES))
def j10_correlated_counts(spark: SparkSession, d: str) -> DataFrame:
    e = tables.episodes(spark, d).withColumn("id", F.col("sequence_number"))
    return aggregate.session_stats(e, tables.facts(spark, d)).select("session_id", "fact_count")


NAMES = """people AS (SELECT c_custkey AS id, lower(c_name) AS name, c_custkey AS position FROM customer), asked AS (SELECT DISTINCT lower(trim(q)) AS q FROM (SELECT 'customer#' || s_suppkey AS q FROM supplier UNION ALL SELECT 'The ' || c_name || ' account' FROM customer UNION ALL SELECT c_name FROM customer UNION ALL SELECT 'I')),
  ranked AS (SELECT q, id, CASE WHEN name = q THEN 1 WHEN contains(q, name) THEN 2 WHEN contains(name, q) THEN 3 WHEN regexp_replace(name, '[^a-z0-9\\s]', '', 'g') = regexp_replace(q, '[^a-z0-9\\s]', '', 'g') THEN 4 END AS r, position FROM asked, people WHERE q <> 'i')"""


@query("SELECT q AS name, id AS entity_id FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY r, position) AS n FROM ranked WHERE r IS NOT NULL) WHERE n = 1 UNION ALL SELECT 'i', min(id) FROM people", (NAMES,))
def j14_resolve_names(spark: SparkSession, d: str) -> DataFrame:
    """Exact, contained, containing and first-person names, against all customers."""
    c = tables.read(spark, d, "customer")
    people = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("Person").alias("entity_type"), F.col("c_custkey").alias("position"))
    s = tables.read(spark, d, "supplier").select(F.concat(F.lit("customer#"), F.col("s_suppkey").cast("string")).alias("subject"))
    asked = s.union(c.select(F.concat(F.lit("The "), "c_name", F.lit(" account")))).union(c.select("c_name")).union(c.limit(1).select(F.lit("I")))
    out = facts.resolve_names(asked.select(F.lower(F.trim("subject")).alias("subject")).distinct(), people, "subject", "entity_id")
    return out.where("entity_id is not null").select(F.col("subject").alias("name"), "entity_id")


@query("SELECT 'NATION_7' AS name WHERE EXISTS (SELECT 1 FROM nation WHERE n_name = 'NATION_7')")
def j15_best_name(spark: SparkSession, d: str) -> DataFrame:
    n = tables.read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("").alias("summary"))
    return retrieval.best_name_match(n, "nation_7").select("name")


@query("SELECT user_id, list_sort(list(DISTINCT event_type)) AS entities, count(*) FILTER (r <= 100) AS facts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) GROUP BY 1")
def j18_user_history(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "events")
    f = e.select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("valid_from"), F.col("event_type").alias("content"))
    links = e.select("user_id", F.col("event_type").alias("entity_id"))
    entities = e.select(F.col("event_type").alias("id"), F.col("event_type").alias("name")).distinct()
    moods = e.select("user_id", F.col("event_type").alias("intent"), F.lit("calm").alias("emotion"))
    return aggregate.user_profile(f, links, entities, moods).select("user_id", "entities", F.size("facts").cast("long").alias("facts"))


@query("SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY n DESC, event_type) AS moods FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY user_id, event_type) WHERE r <= 5 GROUP BY 1")
def a19_profile_moods(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "events")
    none = e.select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("valid_from"), F.lit("x").alias("content"))
    links = e.select("user_id", F.lit(1).alias("entity_id"))
    moods = e.select("user_id", F.col("event_type").alias("intent"), F.lit("").alias("emotion"))
    out = aggregate.user_profile(none, links, spark.createDataFrame([(1, "n")], "id int, name string"), moods)
    return out.select("user_id", F.array_join(F.transform("moods", lambda m: F.concat_ws("=", m["intent"], m["n"].cast("string"))), ",").alias("moods"))


@query("SELECT s_suppkey AS subject_entity_id, a.n_name AS subject_name, b.n_name AS related_name FROM supplier JOIN nation a ON s_nationkey = a.n_nationkey LEFT JOIN nation b ON b.n_nationkey = s_nationkey + 20")
def j19_observation_names(spark: SparkSession, d: str) -> DataFrame:
    s = tables.read(spark, d, "supplier")
    o = s.select("s_suppkey", F.col("s_nationkey").alias("subject_entity_id"), (F.col("s_nationkey") + 20).alias("related_entity_id"))
    n = tables.read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return observations.with_names(o, n).select(F.col("s_suppkey").alias("subject_entity_id"), "subject_name", "related_name")


@query("SELECT session_id, count(*) AS extractions, count(DISTINCT id) AS episodes FROM events JOIN episodes ON user_id = session_id AND event_type <> 'view' AND event_id % 7 = sequence_number GROUP BY 1", (EPISODES,))
def j20_extractions(spark: SparkSession, d: str) -> DataFrame:
    x = tables.read(spark, d, "events").where("event_type <> 'view'").select("event_id", (F.col("user_id") * 1000 + F.col("event_id") % 7).alias("episode_id"))
    return aggregate.extraction_counts(aggregate.extractions_of(x, tables.episodes(spark, d)))


@query("SELECT id, content FROM (SELECT id, content FROM episodes WHERE session_id = 3 ORDER BY sequence_number, id LIMIT 20)", (EPISODES,))
def j21_messages_page(spark: SparkSession, d: str) -> DataFrame:
    e = tables.episodes(spark, d)
    page = paging.keyset_page(e.where("session_id = 3"), [("sequence_number", True), ("id", True)], 20)
    none = e.limit(0).select(F.col("id").alias("episode_id"), F.lit(0).alias("blob_index"), F.lit("").alias("content_hash"), F.lit("").alias("extracted_text"))
    return retrieval.with_blobs(page, none).select("id", "content")


@query("SELECT DISTINCT l_suppkey AS id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE o_custkey = 7 AND s_nationkey < 12")
def j22_session_listing(spark: SparkSession, d: str) -> DataFrame:
    s = tables.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_nationkey") < 12, "near").otherwise("far").alias("entity_type"))
    episodes = tables.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("session_id"), F.col("o_orderdate").alias("created_at"))
    return GraphStore(s, s.limit(0), tables.links(spark, d), episodes).session_entities(7).where("entity_type = 'near'").select("id")


@query("SELECT c_custkey AS session_id, count(o_orderkey) AS message_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def j23_sessions_with_stats(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("session_id"), F.col("o_orderdate").alias("created_at"), F.lit(63).alias("enrichment_status"))
    stats = aggregate.session_stats(e, tables.facts(spark, d))
    sessions = tables.read(spark, d, "customer").select(F.col("c_custkey").alias("session_id"))
    return sessions.join(stats, "session_id", "left").select("session_id", F.coalesce("message_count", F.lit(0)).alias("message_count"))


# aggregates, windows, pages


@query("SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(DISTINCT a.l_orderkey) AS co_count FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL HAVING count(DISTINCT a.l_orderkey) >= 3")
def a5_pair_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.co_occurrence(tables.links(spark, d), 3)


@query("SELECT session_id, count(*) AS message_count, count(*) FILTER (enrichment_status <> 63) AS pending FROM episodes GROUP BY 1", (EPISODES,))
def a9_batch_session_stats(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.session_stats(tables.episodes(spark, d), tables.facts(spark, d)).select("session_id", "message_count", "pending")


@query("SELECT user_id, round(mean, 2) AS mean_gap_hours, round(sd, 2) AS std_gap_hours FROM kinds", (GAPS,))
def a13_gap_statistics(spark: SparkSession, d: str) -> DataFrame:
    return observations.temporal_patterns(tables.read(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "mean_gap_hours", "std_gap_hours")


@query("SELECT p_type || ' ' || p_brand AS name, count(*) OVER (PARTITION BY regexp_replace(lower(p_type || p_brand), '[^a-z0-9]', '', 'g')) AS n, p_partkey FROM part")
def a14_identity_counts(spark: SparkSession, d: str) -> DataFrame:
    p = tables.read(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_type", "p_brand").alias("name"))
    return aggregate.identity_counts(p, tx.identity_term(F.col("name"))).select("p_partkey", "name", "n")


@query("SELECT project_id, count(*) AS observations, count(DISTINCT role) AS kinds FROM episodes GROUP BY 1", (EPISODES,))
def a18_observation_counts(spark: SparkSession, d: str) -> DataFrame:
    return tables.episodes(spark, d).groupBy("project_id").agg(F.count(F.lit(1)).alias("observations"), F.countDistinct("role").alias("kinds"))


@query("SELECT c_nationkey AS org, CASE WHEN count(*) <= 1 THEN 'invite_member' ELSE '' END AS actions FROM customer GROUP BY 1")
def a20_quick_actions(spark: SparkSession, d: str) -> DataFrame:
    counts = tables.read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("org")).agg(F.count(F.lit(1)).alias("members")).withColumns({"projects": F.lit(1), "episodes": F.lit(1)})
    return aggregate.quick_actions(counts).select("org", F.array_join("actions", ",").alias("actions"))


@query("SELECT event_id, round(epoch_us(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 3600000000.0, 6) AS gap FROM events")
def w3_gaps(spark: SparkSession, d: str) -> DataFrame:
    return observations.gaps(tables.read(spark, d, "events"), "user_id", "ts", "event_id").select("event_id", F.round("gap", 6).alias("gap"))


@query("SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders ORDER BY rank LIMIT 50")
def w4_rank_of_list(spark: SparkSession, d: str) -> DataFrame:
    o = tables.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    return retrieval.ranked(o.orderBy(F.desc("score"), "id").limit(50), 1).select("id", F.col("rank").cast("long").alias("rank"))


@query("SELECT id, min(depth) AS depth FROM (SELECT 'n:' || n_nationkey AS id, 1 AS depth FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 's:' || s_suppkey, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 0 UNION ALL SELECT 'c:' || c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0 UNION ALL SELECT 'r:0', 0) GROUP BY 1")
def w6_least_depth(spark: SparkSession, d: str) -> DataFrame:
    e = tables.relationships(spark, d).withColumn("invalid_at", F.lit(None).cast("timestamp_ntz"))
    return graph.bfs(graph.live_edges(e), spark.createDataFrame([("r:0",)], "id string"), 2, "in")


@query("SELECT id, min(depth) AS depth FROM (SELECT 'n:' || n_nationkey AS id, 1 AS depth FROM nation WHERE n_regionkey IN (0, 1) UNION ALL SELECT * FROM (VALUES ('r:0', 0), ('r:1', 0))) GROUP BY 1")
def g3_multi_source_bfs(spark: SparkSession, d: str) -> DataFrame:
    e = tables.relationships(spark, d).withColumn("invalid_at", F.lit(None).cast("timestamp_ntz"))
    return graph.bfs(graph.live_edges(e), spark.createDataFrame([("r:0",), ("r:1",)], "id string"), 1)


@query("SELECT o_orderkey, (SELECT count(*) FROM orders) > 200 AS has_more FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 200")
def l2_clamped_probe(spark: SparkSession, d: str) -> DataFrame:
    return paging.keyset_page(tables.read(spark, d, "orders"), [("o_orderdate", True), ("o_orderkey", True)], 9999, ceiling=200).select("o_orderkey", "has_more")


@query("SELECT id FROM edges WHERE (valid_from, id) < (TIMESTAMP '1996-01-01 00:00:00', 0) ORDER BY valid_from DESC, id DESC LIMIT 40", (EDGES,))
def l8_edge_listing(spark: SparkSession, d: str) -> DataFrame:
    e = tables.temporal_edges(spark, d).withColumn("created_at", F.col("valid_from"))
    return graph.listing(e, 40, [ts("1996-01-01 00:00:00"), 0]).select("id")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1996-01-01 00:00:00' ORDER BY o_orderdate, o_orderkey LIMIT 200")
def l11_oldest_stale(spark: SparkSession, d: str) -> DataFrame:
    s = tables.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("updated_at"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("closed_at"))
    return paging.stale_sessions(s, ts("1996-01-01 00:00:00"), 200).select("id")


@query("SELECT c_custkey, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS total FROM customer WHERE c_acctbal > 0 ORDER BY c_custkey LIMIT 25 OFFSET 25")
def l12_counted_page(spark: SparkSession, d: str) -> DataFrame:
    c = tables.read(spark, d, "customer").where("c_acctbal > 0")
    return paging.offset_page(c, [F.asc("c_custkey")], 2, 25).crossJoin(c.agg(F.count(F.lit(1)).alias("total"))).select("c_custkey", "total")  # one row


@query("SELECT id, min(depth) AS depth FROM walk GROUP BY id", ("pairs AS (SELECT 'n:' || n_nationkey AS a, 'r:' || n_regionkey AS b FROM nation UNION SELECT 'r:' || n_regionkey, 'n:' || n_nationkey FROM nation)", "walk AS (SELECT 'n:0' AS id, 0 AS depth UNION SELECT b, depth + 1 FROM walk JOIN pairs ON id = a WHERE depth < 4)"))
def u2_recursive_union(spark: SparkSession, d: str) -> DataFrame:
    e = tables.relationships(spark, d).where("source_id like 'n:%'").withColumn("invalid_at", F.lit(None).cast("timestamp_ntz"))
    return graph.bfs(graph.live_edges(e), spark.createDataFrame([("n:0",)], "id string"), 4)


@query("SELECT 'nation' AS type, CAST(n_nationkey AS VARCHAR) AS id, n_name AS label FROM nation WHERE contains(lower(n_name), '1') ORDER BY label, n_nationkey LIMIT 30")
def u6_typed_union(spark: SparkSession, d: str) -> DataFrame:
    n = tables.read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"))
    return retrieval.global_search({"nation": (n, "label", ["label"])}, "1", 90)


@query("SELECT 'customer' AS type, count(*) AS n FROM customer WHERE contains(lower(c_name), '7') UNION ALL SELECT 'supplier', count(*) FROM supplier WHERE contains(lower(s_name), '7')")
def r14_global_search(spark: SparkSession, d: str) -> DataFrame:
    legs = {}
    for t in ("customer", "supplier"):
        name = t[0] + "_name"
        legs[t] = (tables.read(spark, d, t).select(F.col(f"{t[0]}_{'cust' if t == 'customer' else 'supp'}key").alias("id"), F.col(name).alias("label")), "label", ["label"])
    return retrieval.global_search(legs, "7", 3_000_000).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, p_type IN ('likes', 'loves', 'enjoys', 'prefers') AS known, 1 AS n FROM part")
def u7_synonym_sets(spark: SparkSession, d: str) -> DataFrame:
    """Words without synonyms keep a set of themselves."""
    s = F.size(facts.expand_predicate(F.lower("p_type")))
    return tables.read(spark, d, "part").select("p_partkey", (s > 1).alias("known"), s.alias("n"))


# functions


def _grams_sql(column: str) -> str:
    return f"list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({column}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(f"SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM (SELECT p_partkey, {_grams_sql('p_name')} AS a, {_grams_sql('p_type')} AS b FROM part)")
def f2_trigram_similarity(spark: SparkSession, d: str) -> DataFrame:
    return tables.read(spark, d, "part").select("p_partkey", F.round(tx.trigram_similarity(F.col("p_name"), F.col("p_type")), 6).alias("similarity"))


@query("SELECT doc_id, substr(sha256(source), 1, 16) || ':2024' AS key FROM documents")
def f7_cache_key(spark: SparkSession, d: str) -> DataFrame:
    return tables.read(spark, d, "documents").select("doc_id", tx.cache_key(F.col("source"), F.lit("2024")).alias("key"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice / 7, 4) AS r4, round(l_quantity / 3, 2) AS r2 FROM lineitem")
def f9_round(spark: SparkSession, d: str) -> DataFrame:
    return tables.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") / 7, 4).alias("r4"), F.round(F.col("l_quantity") / 3, 2).alias("r2"))


@query("SELECT event_id, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day, strftime(ts - INTERVAL 24 HOURS, '%Y-%m-%d %H:%M:%S') AS before FROM events")
def f10_date_trunc(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "events")
    return e.select("event_id", F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd HH:mm:ss").alias("day"), F.date_format(F.col("ts") - F.expr("interval 24 hours"), "yyyy-MM-dd HH:mm:ss").alias("before"))


@query("SELECT p_partkey, greatest(p_size, 20) AS hi, least(p_size, 20) AS lo, CASE WHEN p_size > 25 THEN 'big' ELSE coalesce(nullif(p_brand, ''), 'none') END AS kind FROM part")
def f12_case(spark: SparkSession, d: str) -> DataFrame:
    p = tables.read(spark, d, "part")
    return p.select("p_partkey", F.greatest("p_size", F.lit(20)).alias("hi"), F.least("p_size", F.lit(20)).alias("lo"), F.when(F.col("p_size") > 25, "big").otherwise(F.coalesce(F.nullif("p_brand", F.lit("")), F.lit("none"))).alias("kind"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_brand, '^[a-zA-Z0-9_]+$') THEN p_brand END AS brand, CASE WHEN regexp_matches(p_type, '^[a-zA-Z0-9_]+$') THEN p_type END AS type FROM part")
def f18_edge_type(spark: SparkSession, d: str) -> DataFrame:
    return tables.read(spark, d, "part").select("p_partkey", tx.edge_type(F.col("p_brand")).alias("brand"), tx.edge_type(F.col("p_type")).alias("type"))


@query("SELECT event_id, round(1 - 1 / (1 + value), 9) AS score FROM events")
def f19_unit_score(spark: SparkSession, d: str) -> DataFrame:
    return tables.read(spark, d, "events").select("event_id", F.round(tx.unit_score(F.col("value")), 9).alias("score"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) >= 10")
def s32_json_scalars(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))
    return e.where("k >= 10")


# retrieval and graph


@query("SELECT id, score FROM lex ORDER BY score DESC, id LIMIT 10", (FACTS, f"docs AS (SELECT doc_id AS id, text AS content, source FROM documents JOIN (SELECT id FROM facts WHERE {LIVE}) f ON f.id = doc_id)", TOKENS, BM25))
def r4_lexical_asof(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    rows = docs.join(tables.facts(spark, d).select("id", "valid_from", "valid_to", "invalid_at"), "id")
    return retrieval.lexical_topk(rows, LEXICAL, 10, as_of=ts(AS_OF)).select("id", "score")


@query(f"SELECT count(*) AS n FROM facts WHERE {LIVE}", (FACTS,))
def t10_as_of_legs(spark: SparkSession, d: str) -> DataFrame:
    """The fact leg and the graph leg of one instant see the same facts."""
    f = tables.facts(spark, d).withColumns({"source_id": F.col("subject"), "target_id": F.col("object"), "relationship_type": F.col("predicate")})
    legs = graph.live_edges(f, ts(AS_OF)).where(~F.coalesce(F.col("valid_to") == ts(AS_OF), F.lit(False)))
    return f.where(effective_at(ts(AS_OF))).join(legs.select("id"), "id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) > 0 AS found, bool_and(id <> 5) AS others FROM (SELECT doc_id AS id FROM documents LIMIT 1)")
def r13_similar_episodes(spark: SparkSession, d: str) -> DataFrame:
    """An episode whose content is a passage that others share."""
    docs = tables.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    probe = docs.where("id = 5").select("id", F.lit(LEXICAL).alias("content")).union(docs.where("id <> 5"))
    return retrieval.similar_to(probe, 5, 6).agg((F.count(F.lit(1)) > 0).alias("found"), F.bool_and(F.col("id") != 5).alias("others"))


@query("SELECT cluster, max_by(s_suppkey, (s_acctbal, s_suppkey)) AS canonical_id FROM (SELECT *, s_nationkey AS cluster FROM supplier) GROUP BY 1")
def g9_canonical(spark: SparkSession, d: str) -> DataFrame:
    s = tables.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("cluster"), F.col("s_acctbal").alias("created_at"))
    return graph.canonical(s.select("id", "created_at"), s.select("id", "cluster"))


@query("SELECT c_custkey AS id, n_name AS cluster FROM customer JOIN nation ON c_nationkey = n_nationkey")
def g8_exact_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Names that differ in case and blanks are one cluster, named by its first entity."""
    c = tables.read(spark, d, "customer").join(tables.read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), F.lower("n_name"))).otherwise(F.col("n_name")).alias("name"), "n_name")
    clusters = graph.duplicate_clusters(rows.select(F.col("id").cast("string").alias("id"), "name"), 0.999)
    names = rows.select(F.col("id").cast("string").alias("cluster"), F.col("n_name").alias("shown"))
    return clusters.join(names, "cluster").select(F.col("id").cast("long").alias("id"), F.col("shown").alias("cluster"))


@query("SELECT id, valid_from >= TIMESTAMP '1996-01-01 00:00:00' AS expired FROM edges", (EDGES,))
def g11_expire(spark: SparkSession, d: str) -> DataFrame:
    e = tables.temporal_edges(spark, d).withColumn("relationship_type", F.when(F.col("valid_from") >= ts("1996-01-01 00:00:00"), "late").otherwise("early"))
    late = e.where("relationship_type = 'late'").select("source_id", "target_id", "relationship_type")
    return graph.expire(e, late, ts("1999-01-01 00:00:00")).select("id", F.col("invalid_at").isNotNull().alias("expired"))


@query("SELECT 's:' || s_suppkey AS source_id, 'community:' || s_nationkey AS target_id FROM supplier WHERE s_nationkey IN (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING count(*) >= 2)")
def g7_member_edges(spark: SparkSession, d: str) -> DataFrame:
    labels = tables.read(spark, d, "supplier").select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_nationkey").alias("label"))
    kept = labels.groupBy("label").agg(F.count(F.lit(1)).alias("member_count")).where("member_count >= 2")
    return graph.member_edges(labels, kept).select("source_id", "target_id")


@query("SELECT name, entity_type FROM (SELECT lower(c_name) AS name, 'customer' AS entity_type FROM customer UNION SELECT lower(n_name), 'Custom' FROM nation JOIN customer ON c_nationkey = n_nationkey)")
def g17_materialise(spark: SparkSession, d: str) -> DataFrame:
    """Endpoints that no extracted entity names are created as Custom."""
    c = tables.read(spark, d, "customer").join(tables.read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    relations = c.select(F.col("c_name").alias("source"), F.col("n_name").alias("target"), F.lit("in").alias("type"), F.lit(0.9).alias("confidence"))
    entities = c.select(F.col("c_name").alias("name"), F.lit("customer").alias("entity_type"))
    new, _ = ingest.materialise(relations, entities, entities.limit(0).select(F.lower("name").alias("name")))
    return new.select("name", "entity_type")


@query("SELECT DISTINCT entity_type, count(*) AS n, (SELECT count(*) FROM supplier) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) AS edges FROM entities GROUP BY entity_type", (ENTITIES,))
def g18_graph_store(spark: SparkSession, d: str) -> DataFrame:
    """The store as one object: its entities by type, and the number of its active edges."""
    e = tables.relationships(spark, d).withColumns({"created_at": F.lit(0), "id": F.lit(0), "invalid_at": F.lit(None).cast("timestamp_ntz")})
    store = GraphStore(tables.entities(spark, d), e)
    edges = store.all_edges().agg(F.count(F.lit(1)).alias("edges"))
    return store.list_entities().groupBy("entity_type").agg(F.count(F.lit(1)).alias("n")).crossJoin(edges)  # one row


@query("SELECT id, similarity FROM (SELECT n_nationkey AS id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM (SELECT n_nationkey, " + _grams_sql("n_name") + " AS a, " + _grams_sql("'nation 1'") + " AS b FROM nation)) WHERE similarity > 0.3 ORDER BY similarity DESC, id LIMIT 50")
def r12_bulk_search(spark: SparkSession, d: str) -> DataFrame:
    n = tables.read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return GraphStore(n, n.limit(0)).bulk_search_entities("nation 1").select("id", "similarity")


# facts, observations, ingest


@query("SELECT subject, count(*) AS pairs FROM (SELECT a.subject FROM facts a JOIN facts b ON a.subject = b.subject AND a.predicate = b.predicate AND a.object = b.object AND a.id < b.id AND (b.valid_to IS NULL OR a.valid_from < b.valid_to) AND (a.valid_to IS NULL OR b.valid_from < a.valid_to)) GROUP BY 1", (FACTS,))
def t8_overlap_report(spark: SparkSession, d: str) -> DataFrame:
    return facts.overlap_pairs(tables.facts(spark, d), facts.TRIPLE).groupBy("subject").agg(F.count(F.lit(1)).alias("pairs"))


@query("SELECT batch, count(*) AS sent, count(DISTINCT h) AS distinct_batches FROM (SELECT source_episode_id % 5 AS batch, source_episode_id, sha256(string_agg(subject || predicate || object, ',' ORDER BY subject, predicate, object)) AS h FROM facts GROUP BY ALL) GROUP BY 1", (FACTS,))
def t9_batch_memo(spark: SparkSession, d: str) -> DataFrame:
    """Batches by the hash of their sorted triples: a batch sent again has a hash that is known."""
    hashed = facts.batch_hash(tables.facts(spark, d), ["source_episode_id"])
    return hashed.groupBy((F.col("source_episode_id") % 5).alias("batch")).agg(F.count(F.lit(1)).alias("sent"), F.countDistinct("batch_hash").alias("distinct_batches"))


@query("SELECT old_id, new_id FROM (SELECT id AS old_id, lead(id) OVER (PARTITION BY subject, predicate ORDER BY valid_from, id) AS new_id, valid_to FROM facts) WHERE old_id = 7 OR new_id = 7", (FACTS,))
def t11_lineage_read(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("subject", "predicate").orderBy("valid_from", "id")
    events = tables.facts(spark, d).select(F.col("id").alias("old_id"), F.lead("id").over(w).alias("new_id"), F.col("valid_to").alias("at_time"))
    return facts.lineage(events, 7).select("old_id", "new_id")


@query("SELECT user_id, pattern_type FROM kinds WHERE pattern_type IN ('widening', 'narrowing')", (GAPS,))
def o3_monotonic(spark: SparkSession, d: str) -> DataFrame:
    return observations.temporal_patterns(tables.read(spark, d, "events"), "user_id", "ts", "event_id").where("pattern_type in ('widening', 'narrowing')").select("user_id", "pattern_type")


@query("SELECT user_id, gap_count FROM kinds WHERE pattern_type = 'burst'", (GAPS,))
def o4_burst(spark: SparkSession, d: str) -> DataFrame:
    return observations.temporal_patterns(tables.read(spark, d, "events"), "user_id", "ts", "event_id").where("pattern_type = 'burst'").select("user_id", "gap_count")


@query("SELECT user_id, CASE pattern_type WHEN 'periodic' THEN 0.85 WHEN 'widening' THEN 0.75 WHEN 'narrowing' THEN 0.7 WHEN 'burst' THEN 0.65 ELSE 0.4 END AS confidence FROM kinds", (GAPS,))
def o7_confidence(spark: SparkSession, d: str) -> DataFrame:
    return observations.temporal_patterns(tables.read(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "confidence")


@query("SELECT 'temporal_pattern' AS observation_type, count(*) AS n FROM kinds UNION ALL SELECT 'behavioral_pattern', count(DISTINCT user_id) FROM (SELECT user_id FROM events GROUP BY user_id, event_type HAVING count(*) >= 2)", (GAPS,))
def o9_full_scan(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "events")
    none = F.lit(None).cast("timestamp_ntz")
    f = e.select(F.col("user_id").alias("subject"), F.col("event_type").alias("predicate"), none.alias("valid_from"), none.alias("valid_to"), none.alias("invalid_at"))
    links = e.select(F.col("event_id").alias("episode_id"), F.col("user_id").alias("entity_id"))
    return observations.observations(links, e, f, ts(AS_OF), "user_id", "ts", "event_id").groupBy("observation_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id AS subject_entity_id, event_type AS subject_name FROM kinds JOIN (SELECT user_id, min(event_type) AS event_type FROM events GROUP BY 1) USING (user_id) WHERE pattern_type <> 'periodic'", (GAPS,))
def o10_named_observations(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "events")
    o = observations.temporal_patterns(e, "user_id", "ts", "event_id").where("pattern_type <> 'periodic'").select(F.col("user_id").alias("subject_entity_id"), F.lit(None).cast("long").alias("related_entity_id"))
    names = e.groupBy(F.col("user_id").alias("id")).agg(F.min("event_type").alias("name"))
    return observations.with_names(o, names).select("subject_entity_id", "subject_name")


SAID = """said AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'id ' || lpad(CAST(user_id % 1000 AS VARCHAR), 3, '0') || '-12-' || lpad(CAST(event_id % 10000 AS VARCHAR), 4, '0') || ' end'
  WHEN 1 THEN 'card 4111 1111 1111 ' || lpad(CAST(event_id % 10000 AS VARCHAR), 4, '0') || ' end' WHEN 2 THEN 'host 10.0.' || event_id % 256 || '.' || user_id % 256 || ' end' WHEN 3 THEN 'call +1 415 555 ' || lpad(CAST(event_id % 10000 AS VARCHAR), 4, '0') || ' end'
  WHEN 4 THEN 'key AKIA' || lpad(CAST(event_id AS VARCHAR), 16, 'X') || ' end' ELSE 'pay 0x' || lpad(CAST(event_id AS VARCHAR), 40, 'a') || ' end' END AS content FROM events)"""


def _said(spark: SparkSession, d: str) -> DataFrame:
    """One piece of personal data for each event, of six kinds by turns."""
    e = tables.read(spark, d, "events")
    four = F.lpad((F.col("event_id") % 10000).cast("string"), 4, "0")
    s = lambda c: c.cast("string")
    texts = [
        F.concat(F.lit("id "), F.lpad(s(F.col("user_id") % 1000), 3, "0"), F.lit("-12-"), four), F.concat(F.lit("card 4111 1111 1111 "), four), F.concat(F.lit("host 10.0."), s(F.col("event_id") % 256), F.lit("."), s(F.col("user_id") % 256)),
        F.concat(F.lit("call +1 415 555 "), four), F.concat(F.lit("key AKIA"), F.lpad(s(F.col("event_id")), 16, "X")), F.concat(F.lit("pay 0x"), F.lpad(s(F.col("event_id")), 40, "a")),
    ]
    out = texts[-1]
    for k in range(5):
        out = F.when(F.col("event_id") % 6 == k, texts[k]).otherwise(out)
    return e.select("event_id", F.concat(out, F.lit(" end")).alias("content"))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'ssn' WHEN 1 THEN 'credit_card' WHEN 2 THEN 'ip_address' WHEN 3 THEN 'phone' WHEN 4 THEN 'api_key' ELSE 'crypto_wallet' END AS kind, 1 AS n FROM events")
def i3_overlap_merge(spark: SparkSession, d: str) -> DataFrame:
    """All seven detectors run; of the spans that overlap one stays, of the kind that fits best."""
    found = _said(spark, d).withColumn("p", pii.detect(F.col("content")))
    return found.select("event_id", F.get("p", F.lit(0))["type"].alias("kind"), F.size("p").alias("n"))


@query("SELECT event_id, strpos(content, ' ') AS first_at, length(content) - 4 AS last_at FROM said", (SAID,))
def i4_ordered_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans of enough confidence in the order of their start; each text has one, from its first blank to its last."""
    found = _said(spark, d).withColumn("p", pii.detect(F.col("content"), least=0.9))
    return found.select("event_id", F.get("p", F.lit(0))["start"].cast("long").alias("first_at"), F.get("p", F.size("p") - 1)["end"].cast("long").alias("last_at"))


@query("SELECT event_id FROM said WHERE false", (SAID,))
def i6_block_policy(spark: SparkSession, d: str) -> DataFrame:
    """With the policy ``block`` none of the texts passes."""
    passed, _ = ingest.apply_policy(_said(spark, d), "block")
    return passed.select("event_id")


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'id [REDACTED:SSN] end' WHEN 1 THEN 'card [REDACTED:CARD] end' WHEN 2 THEN 'host [REDACTED:IP] end' WHEN 3 THEN 'call [REDACTED:PHONE] end' WHEN 4 THEN 'key [REDACTED:KEY] end' ELSE 'pay [REDACTED:WALLET] end' END AS content FROM said", (SAID,))
def i5_mask_all_kinds(spark: SparkSession, d: str) -> DataFrame:
    passed, _ = ingest.apply_policy(_said(spark, d), "mask")
    return passed.select("event_id", "content")


@query("SELECT id, enrichment_status | CASE WHEN role = 'user' THEN 64 ELSE 0 END AS enrichment_status FROM episodes", (EPISODES,))
def d3_progress_bits(spark: SparkSession, d: str) -> DataFrame:
    e = tables.episodes(spark, d)
    return upsert.set_bits(e, e.where("role = 'user'").select("id", F.lit(64).alias("bit"))).select("id", "enrichment_status")


@query("SELECT user_id, strftime(date_trunc('hour', ts) - to_hours(k), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY ALL")
def d5_sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    """The streaming operator on a table: events of a user in windows of two hours, one each hour."""
    e = tables.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.sliding_counts(e, "user_id", "ts", "2 hours", "1 hour", "1 hour").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS attempts FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 3 HOURS THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def d6_attempt_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Attempts of a user in sessions that end three hours after the last."""
    e = tables.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.attempt_counters(e, "user_id", "ts", "3 hours", "1 hour").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "attempts")


@query("SELECT project_id AS organization_id, 'webhook' AS effect, CASE WHEN role = 'user' THEN 'message.added' ELSE 'fact.superseded' END AS event_type, CAST(id AS VARCHAR) AS id FROM episodes UNION ALL SELECT DISTINCT project_id, 'purge', NULL, 'context:*' FROM episodes WHERE role <> 'user'", (EPISODES,))
def d12_effects(spark: SparkSession, d: str) -> DataFrame:
    user = F.col("role") == "user"
    changes = tables.episodes(spark, d).select(F.col("project_id").alias("organization_id"), F.when(user, "message").otherwise("fact").alias("what"), F.when(user, "created").otherwise("superseded").alias("happened"), "id")
    return effects.effects(changes)


@query("SELECT user_id, CASE WHEN count(*) FILTER (event_type <> 'view') = 0 THEN 'skipped' WHEN count(*) FILTER (event_type NOT IN ('view', 'error')) = 0 THEN 'error' WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'partial' ELSE 'completed' END AS status FROM events GROUP BY 1")
def d16_job_status(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "skipped").otherwise("ok")
    return effects.job_status(tables.read(spark, d, "events").withColumn("outcome", outcome), ["user_id"]).select("user_id", "status")


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'fact.retracted' WHEN 'view' THEN 'session.created' END AS event_type FROM events")
def d17_event_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "events")
    what = F.when(F.col("event_type") == "error", "fact").when(F.col("event_type") == "view", "session").otherwise("fact")
    happened = F.when(F.col("event_type") == "error", "retracted").when(F.col("event_type") == "view", "created").otherwise("viewed")
    return e.select("event_id", effects.event_type(what, happened).alias("event_type"))


@query("SELECT name, entity_type, summary, CASE WHEN s IS NULL THEN 'created' ELSE 'updated' END AS action FROM (SELECT lower(n_name) AS name, 'Place' AS entity_type, 'new' AS summary, (SELECT min(s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey) AS s FROM nation)")
def s40_change_detection(spark: SparkSession, d: str) -> DataFrame:
    n = tables.read(spark, d, "nation")
    base = n.select(F.lit(1).alias("organization_id"), F.lit(1).alias("project_id"), F.col("n_nationkey").alias("id"), F.lower("n_name").alias("name"))
    have = base.join(tables.read(spark, d, "supplier").select(F.col("s_nationkey").alias("id")).distinct(), "id", "left_semi").select("organization_id", "project_id", "id", "name", F.lit("Custom").alias("entity_type"), F.lit("old").alias("summary"))
    batch = base.select("organization_id", "project_id", "id", "name", F.lit("Place").alias("entity_type"), F.lit("new").alias("summary"), F.lit(1).alias("at"))
    return upsert.upsert_entities(have, batch).select("name", "entity_type", "summary", "action")
