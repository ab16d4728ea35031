"""Queries of the remaining store operators: lookups, updates, joins, filters, formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.temporal import parse_instant, validity_suffix
from ..functions.vector import cosine_distance
from ..operators import aggregate, facts, graph, ingest, observations, paging, retrieval, upsert
from ..sources import tables
from .registry import query, text, ts
from .retrieval import DOCS
from .temporal import AS_OF, EDGES, EPISODES, FACTS, LIVE

ENTITIES = """entities AS (SELECT 's:' || s_suppkey AS id, s_name AS name, 'supplier' AS entity_type FROM supplier UNION ALL SELECT 'c:' || c_custkey, c_name, 'customer' FROM customer
  UNION ALL SELECT 'n:' || n_nationkey, n_name, 'nation' FROM nation UNION ALL SELECT 'r:' || r_regionkey, r_name, 'region' FROM region)"""
SHOW = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"


@query("SELECT id, content, role FROM episodes WHERE id IN (0, 1001, 2000, 7002)", (EPISODES,))
def s3_batch_lookup(spark: SparkSession, d: str) -> DataFrame:
    return tables.by_ids(tables.episodes(spark, d), [0, 1001, 2000, 7002]).select("id", "content", "role")


@query("SELECT id, role FROM episodes WHERE project_id = 2 AND enrichment_status <> 7", (EPISODES,))
def s1_tenant_scan(spark: SparkSession, d: str) -> DataFrame:
    e = tables.episodes(spark, d).withColumn("is_deleted", F.col("enrichment_status") == 7)
    return tables.live(tables.tenant_scope(e, project_id=2)).select("id", "role")


@query("SELECT id, name, entity_type FROM entities", (ENTITIES,))
def s4_all_entities(spark: SparkSession, d: str) -> DataFrame:
    return tables.entities(spark, d).orderBy("name", "id")


@query("SELECT DISTINCT l_suppkey AS id, s_name AS name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def s6_resolve_names(spark: SparkSession, d: str) -> DataFrame:
    ids = tables.read(spark, d, "lineitem").select("l_suppkey")
    s = tables.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return tables.by_ids(s, ids)


@query(f"SELECT id, {SHOW.format('valid_to')}, {SHOW.format('invalid_at')} FROM (SELECT id, CASE WHEN id % 9 = 0 AND invalid_at IS NULL AND valid_to IS NULL THEN TIMESTAMP '{AS_OF}' ELSE invalid_at END AS invalid_at, valid_to FROM facts)", (FACTS,))
def t4_retract(spark: SparkSession, d: str) -> DataFrame:
    f = tables.facts(spark, d)
    store, _ = facts.retract(f, f.where("id % 9 = 0").select("id"), ts(AS_OF))
    return store.select("id", text("valid_to"), text("invalid_at"))


@query("SELECT id AS old_id, 'llm_invalidated' AS kind, 'r' || id % 3 AS reason FROM facts WHERE id % 11 = 0 AND invalid_at IS NULL AND valid_to IS NULL", (FACTS,))
def t3_llm_invalidate(spark: SparkSession, d: str) -> DataFrame:
    f = tables.facts(spark, d)
    picked = f.where("id % 11 = 0")
    refs = picked.select(F.concat(F.lit("E"), F.col("id").cast("string")).alias("ref"), "id")
    commands = picked.select(F.concat(F.lit("E"), F.col("id").cast("string")).alias("ref"), F.concat(F.lit("r"), (F.col("id") % 3).cast("string")).alias("reason"))
    return facts.invalidate(f, refs, commands, ts(AS_OF))[1].select("old_id", "kind", "reason")


@query("SELECT count(*) FILTER (project_id = 1) AS deleted, (SELECT count(*) FROM facts WHERE id % 4 = 1 OR invalid_at IS NOT NULL) AS invalidated FROM episodes", (EPISODES, FACTS))
def s18_project_wipe(spark: SparkSession, d: str) -> DataFrame:
    e = tables.episodes(spark, d).withColumn("is_deleted", F.lit(False))
    f = tables.facts(spark, d).withColumn("project_id", F.col("id") % 4)
    e, f = upsert.wipe_project(e, f, 1, ts(AS_OF))
    return e.agg(F.count_if("is_deleted").alias("deleted")).crossJoin(f.agg(F.count("invalid_at").alias("invalidated")))


@query("SELECT id FROM episodes WHERE enrichment_status & 4 = 0", (EPISODES,))
def s20_unmarked(spark: SparkSession, d: str) -> DataFrame:
    return upsert.unmarked(tables.episodes(spark, d), 4).select("id")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, event_type AS t FROM events")
def s21_merge_patch(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "events")
    patch = F.to_json(F.struct(F.col("event_type").alias("t"), F.lit(None).cast("string").alias("old")), {"ignoreNullFields": "false"})
    old = F.concat(F.lit('{"old":1,'), F.substring("props", F.lit(2), F.length("props")))
    m = e.select("event_id", upsert.merge_patch(old, patch).alias("m"))
    return m.where("NOT map_contains_key(m, 'old')").select("event_id", F.col("m")["k"].alias("k"), F.col("m")["t"].alias("t"))


@query("SELECT c_custkey, coalesce(n_name, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN nation ON c_custkey = n_nationkey")
def s22_partial_update(spark: SparkSession, d: str) -> DataFrame:
    u = tables.read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("c_custkey"), F.col("n_name").alias("c_mktsegment"))
    return upsert.apply_updates(tables.read(spark, d, "customer").select("c_custkey", "c_mktsegment"), u, "c_custkey", ["c_mktsegment"])


@query("SELECT n_nationkey AS id, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) + 1 AS edges FROM nation")
def s23_entity_with_edges(spark: SparkSession, d: str) -> DataFrame:
    e = tables.relationships(spark, d).where("source_id not like 'c:%'")
    n = tables.entities(spark, d).where("entity_type = 'nation'")
    return graph.entity_with_edges(n, e).select(F.substring("id", 3, 9).cast("int").alias("id"), F.size("edges").cast("long").alias("edges"))


@query("SELECT l_orderkey, coalesce(n_nationkey, l_suppkey) AS l_suppkey, l_linenumber FROM lineitem LEFT JOIN (SELECT s_suppkey, 1000 + min(s_suppkey) OVER (PARTITION BY s_nationkey) AS n_nationkey FROM supplier) ON l_suppkey = s_suppkey")
def s34_remap(spark: SparkSession, d: str) -> DataFrame:
    s = tables.read(spark, d, "supplier").select(F.col("s_suppkey").alias("old_id"), (F.lit(1000) + F.min("s_suppkey").over(Window.partitionBy("s_nationkey"))).alias("new_id"))
    return upsert.remap(tables.read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber"), s, "l_suppkey")


@query("SELECT n_name AS external_id, s_suppkey IS NULL AS created FROM nation LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 2000) ON n_nationkey = s_suppkey")
def s37_get_or_create(spark: SparkSession, d: str) -> DataFrame:
    n = tables.read(spark, d, "nation")
    store = n.join(tables.read(spark, d, "supplier").where("s_acctbal > 2000"), F.col("n_nationkey") == F.col("s_suppkey")).select(F.col("n_name").alias("external_id"), F.col("s_suppkey").alias("id"))
    return upsert.get_or_create(store, n.select(F.col("n_name").alias("external_id"))).select("external_id", "created")


@query("SELECT id FROM facts WHERE source_episode_id IN (3, 5) AND lower(predicate) NOT IN ('i', 'me')", (FACTS,))
def p10_stop_entities(spark: SparkSession, d: str) -> DataFrame:
    f = tables.facts(spark, d).where("source_episode_id in (3, 5)").select("id", F.col("predicate").alias("source"), F.col("subject").cast("string").alias("target"))
    return ingest.relation_filter(f).select("id")


@query("SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN p_type ELSE 'Custom' END AS entity_type FROM part")
def p11_ontology(spark: SparkSession, d: str) -> DataFrame:
    p = tables.read(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("entity_type"), F.lit("").alias("mention"))
    return ingest.entity_filter(p, ["ECONOMY", "SMALL"]).select("p_partkey", "entity_type")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00' ORDER BY o_orderdate, o_orderkey LIMIT 100")
def p14_stale_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = tables.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("updated_at"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("closed_at"))
    return paging.stale_sessions(s, ts("1997-01-01 00:00:00")).select(F.col("id").alias("o_orderkey"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type END AS intent, least(greatest(value / 50 - 0.2, 0.0), 1.0) AS confidence FROM events WHERE event_id % 10 <> 0")
def s31_classification_sink(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "events")
    nothing = F.lit(None).cast("string")
    r = e.select(F.lit(1).alias("organization_id"), F.col("event_id").alias("episode_id"), F.col("event_type").alias("intent"), nothing.alias("emotion"), nothing.alias("valence"), nothing.alias("arousal"), (F.col("value") / 50 - 0.2).alias("confidence"))
    return upsert.classification_rows(r, r.where("episode_id % 10 = 0"), ["click", "view"], []).select(F.col("episode_id").alias("event_id"), "intent", "confidence")


@query("SELECT a, b, ids FROM (SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, list_sort(list(id)) AS ids FROM edges GROUP BY ALL)", (EDGES,))
def p13_edge_ids_between(spark: SparkSession, d: str) -> DataFrame:
    return graph.edge_ids_between(tables.temporal_edges(spark, d))


@query("SELECT DISTINCT id FROM edges WHERE valid_from <= TIMESTAMP '1995-06-17 00:00:00' AND valid_to >= TIMESTAMP '1995-06-17 00:00:00' AND (source_id = 'c:7' OR target_id = 's:7')", (EDGES,))
def p12_edges_at_time(spark: SparkSession, d: str) -> DataFrame:
    e = graph.live_edges(tables.temporal_edges(spark, d), ts("1995-06-17 00:00:00"))
    return e.where("source_id = 'c:7'").union(e.where("target_id = 's:7'")).select("id").distinct()


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'bolt') AND p_size IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 2000)")
def p8_optional_any(spark: SparkSession, d: str) -> DataFrame:
    p = paging.search_text(tables.read(spark, d, "part"), ["p_name"], "bolt")
    s = tables.read(spark, d, "supplier").where("s_acctbal > 2000").select(F.col("s_suppkey").cast("int").alias("p_size"))
    return p.join(s, "p_size", "left_semi").select("p_partkey")


@query("SELECT a.id AS batch_id, b.id AS store_id FROM facts a JOIN facts b ON a.predicate = b.predicate AND a.subject = b.subject AND a.object = b.object WHERE a.value >= 90 AND " + LIVE.replace("invalid_at", "b.invalid_at").replace("valid_from", "b.valid_from").replace("valid_to", "b.valid_to"), (FACTS,))
def j13_conflict_candidates(spark: SparkSession, d: str) -> DataFrame:
    f = tables.facts(spark, d).withColumns({"subject": F.col("subject").cast("string"), "object": F.col("object").cast("string"), "subject_entity_id": F.lit(None).cast("string"), "object_entity_id": F.lit(None).cast("string")})
    return facts.conflict_candidates(f.where("value >= 90"), f, ts(AS_OF))


@query("SELECT l_orderkey AS id, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) AS blobs, count(*) AS n FROM lineitem GROUP BY 1")
def j16_blobs_of_results(spark: SparkSession, d: str) -> DataFrame:
    li = tables.read(spark, d, "lineitem")
    blobs = li.select(F.col("l_orderkey").alias("episode_id"), F.col("l_linenumber").alias("blob_index"), F.col("l_partkey").cast("string").alias("content_hash"), F.lit("").alias("extracted_text"))
    return retrieval.with_blobs(li.select(F.col("l_orderkey").alias("id")).distinct(), blobs).select("id", F.array_join(F.transform("blobs", lambda b: F.concat_ws(":", b["blob_index"], b["content_hash"])), ",").alias("blobs"), F.size("blobs").cast("long").alias("n"))


@query("SELECT event_id AS episode_id, event_type, content FROM events JOIN episodes ON event_id = id", (EPISODES,))
def j17_classified_episodes(spark: SparkSession, d: str) -> DataFrame:
    c = tables.read(spark, d, "events").select(F.col("event_id").alias("episode_id"), "event_type")
    return aggregate.classified_episodes(c, tables.episodes(spark, d)).select("episode_id", "event_type", "content")


@query("SELECT min(id) AS id FROM edges GROUP BY source_id, target_id, relationship_type", (EDGES,))
def j5_first_of_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.latest(tables.temporal_edges(spark, d), upsert.EDGE_KEY, [F.asc("id")]).select("id")


@query("SELECT count(DISTINCT l_orderkey) AS total FROM lineitem")
def a4_linked_episodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.linked_episodes(tables.links(spark, d))


@query("SELECT project_id, role, count(*) AS n FROM episodes GROUP BY ALL", (EPISODES,))
def a1_tenant_counts(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.tenant_counts(tables.episodes(spark, d), ["project_id", "role"])


@query(
    f"""SELECT subject, predicate, n, count(*) OVER (PARTITION BY subject) AS surviving_predicates, total_facts FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY subject) AS BIGINT) AS total_facts FROM
    (SELECT subject, predicate, count(*) AS n FROM facts WHERE {LIVE} GROUP BY ALL)) WHERE n >= 1""",
    (FACTS,),
)
def a6_predicate_counts(spark: SparkSession, d: str) -> DataFrame:
    return observations.predicate_counts(tables.facts(spark, d), ts(AS_OF), 1)


@query("SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS prompt_tokens, CAST(sum(l_partkey) AS BIGINT) AS completion_tokens, CAST(sum(l_linenumber + l_partkey) AS BIGINT) AS total_tokens, round(sum(l_tax), 4) AS cost_estimate FROM lineitem GROUP BY 1")
def a15_usage_rollup(spark: SparkSession, d: str) -> DataFrame:
    u = tables.read(spark, d, "lineitem").select("l_returnflag", F.col("l_linenumber").alias("prompt_tokens"), F.col("l_partkey").alias("completion_tokens"), F.col("l_tax").alias("cost_estimate"))
    return aggregate.usage_rollup(u, ["l_returnflag"]).withColumn("cost_estimate", F.round("cost_estimate", 4))


@query("SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def w5_latest_version(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.latest(tables.read(spark, d, "orders"), ["o_custkey", "o_orderpriority"], [F.desc_nulls_last("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderpriority", "o_orderkey")


@query("SELECT n_name AS name, version, version = max(version) OVER (PARTITION BY n_name) AS is_active FROM (SELECT n_name, 1 AS version FROM nation UNION ALL SELECT n_name, 1 + row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey) FROM nation JOIN supplier ON s_nationkey = n_nationkey)")
def w7_version_bump(spark: SparkSession, d: str) -> DataFrame:
    n = tables.read(spark, d, "nation")
    old = n.select(F.col("n_name").alias("name"), F.lit(1).alias("version"), F.lit("b").alias("body"), F.lit(True).alias("is_active"), F.lit(True).alias("is_default"))
    new = tables.read(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("name"), F.col("s_name").alias("body"), F.col("s_suppkey").alias("position"))
    return upsert.new_versions(old, new).select("name", F.col("version").cast("long").alias("version"), "is_active")


@query("SELECT DISTINCT id FROM (SELECT id, row_number() OVER (PARTITION BY source_id ORDER BY valid_from DESC, id) AS n FROM edges WHERE source_id IN ('c:1', 'c:2', 'c:4')) WHERE n <= 3", (EDGES,))
def u5_edges_of_subjects(spark: SparkSession, d: str) -> DataFrame:
    e = tables.temporal_edges(spark, d).withColumn("created_at", F.col("valid_from"))
    return graph.edges_of(e, spark.createDataFrame([("c:1",), ("c:2",), ("c:4",)], "id string"), 3).select("id")


@query("SELECT id, min(distance) AS distance FROM (SELECT n_nationkey AS id, n_regionkey AS distance FROM nation UNION ALL SELECT s_nationkey, 2 FROM supplier) GROUP BY id ORDER BY distance, id LIMIT 50")
def u4_union_hits(spark: SparkSession, d: str) -> DataFrame:
    a = tables.read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("distance"))
    b = tables.read(spark, d, "supplier").select(F.col("s_nationkey").alias("id"), F.lit(2).alias("distance"))
    return graph.retrieve_many([a, b])


@query("SELECT r_name AS kind, list_sort(list(n_name)) AS names, count(*) FILTER (n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0)) AS imported FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def u8_group_manifest(spark: SparkSession, d: str) -> DataFrame:
    n, r = tables.read(spark, d, "nation"), tables.read(spark, d, "region")
    s = tables.read(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("n_nationkey"), F.lit(1).alias("x")).distinct()
    j = n.join(r, n.n_regionkey == r.r_regionkey).join(s, "n_nationkey", "left")
    return j.groupBy(F.col("r_name").alias("kind")).agg(F.array_sort(F.collect_list("n_name")).alias("names"), F.count("x").alias("imported"))


@query("SELECT vec_id, round(1 - list_dot_product(CAST(embedding AS DOUBLE[]), q) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(q, q))), 9) AS distance FROM embeddings, (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 3)")
def f4_cosine_distance(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "embeddings")
    q = e.where("vec_id = 3").select(F.col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(q)).select("vec_id", F.round(cosine_distance(F.col("embedding"), F.col("q")), 9).alias("distance"))


@query("SELECT doc_id, sha256('{\"doc_id\":' || doc_id || ',\"source\":\"' || source || '\"}') AS h, substr(sha256(source), 1, 16) AS k FROM documents")
def f5_hashes(spark: SparkSession, d: str) -> DataFrame:
    return tables.read(spark, d, "documents").select("doc_id", tx.content_hash("source", "doc_id").alias("h"), tx.cache_key(F.col("source")).alias("k"))


@query("SELECT subject, sha256('[' || string_agg('{\"subject\":' || subject || ',\"predicate\":\"' || predicate || '\",\"object\":' || object || '}', ',' ORDER BY predicate, object) || ']') AS batch_hash FROM facts GROUP BY subject", (FACTS,))
def f6_batch_hash(spark: SparkSession, d: str) -> DataFrame:
    return facts.batch_hash(tables.facts(spark, d).withColumn("organization_id", F.col("subject")), ["organization_id"]).withColumnRenamed("organization_id", "subject")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS parsed FROM events")
def f8_parse_instant(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "events")
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return e.select("event_id", F.date_format(parse_instant(iso), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("SELECT id, CASE WHEN valid_to IS NULL THEN ' (valid: from ' || strftime(valid_from, '%Y-%m-%d') || ')' ELSE ' (valid: ' || strftime(valid_from, '%Y-%m-%d') || ' to ' || strftime(valid_to, '%Y-%m-%d') || ')' END AS suffix FROM facts", (FACTS,))
def f11_validity_suffix(spark: SparkSession, d: str) -> DataFrame:
    return tables.facts(spark, d).select("id", validity_suffix(F.col("valid_from"), F.col("valid_to")).alias("suffix"))


@query("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS back, o_custkey || '|' || o_orderkey AS plain FROM orders")
def f13_cursor(spark: SparkSession, d: str) -> DataFrame:
    c = tx.encode_cursor(F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"))
    parts = tx.decode_cursor(c)
    return tables.read(spark, d, "orders").select("o_orderkey", parts[1].alias("back"), F.array_join(parts, "|").alias("plain"))


@query("SELECT p_partkey, upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS shown, round(1 - 1 / (1 + p_size), 9) AS score FROM part")
def f15_display_and_score(spark: SparkSession, d: str) -> DataFrame:
    p = tables.read(spark, d, "part")
    return p.select("p_partkey", tx.display_name(F.col("p_name"), F.lit(None).cast("string")).alias("shown"), F.round(tx.unit_score(F.col("p_size")), 9).alias("score"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def f20_json_int(spark: SparkSession, d: str) -> DataFrame:
    return tables.read(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))


@query("SELECT event_id AS id, event_type AS predicate FROM events a WHERE event_id % 13 = 0 AND NOT EXISTS (SELECT 1 FROM events b WHERE b.event_id % 13 <> 0 AND b.event_type = a.event_type AND b.user_id = a.user_id AND floor(b.value / 10) = floor(a.value / 10))")
def t5_synonym_dedupe(spark: SparkSession, d: str) -> DataFrame:
    f = tables.facts(spark, d).withColumns({"subject": F.col("subject").cast("string"), "object": F.col("object").cast("string")})
    return facts.without_synonyms(f.where("id % 13 = 0"), f.where("id % 13 <> 0")).select("id", "predicate")


@query("SELECT a.l_suppkey AS subject_entity_id, b.l_suppkey AS related_entity_id, count(DISTINCT a.l_orderkey) AS co_count, round(least(count(DISTINCT a.l_orderkey) / 20, 1.0), 6) AS confidence FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey GROUP BY ALL HAVING count(DISTINCT a.l_orderkey) >= 25")
def o8_symmetric(spark: SparkSession, d: str) -> DataFrame:
    return observations.symmetric(observations.co_occurrence_patterns(tables.links(spark, d), least=25))


@query(
    "SELECT a, b, '''' || a || ''' appears alongside ''' || b || ''' in ' || n || ' out of ' || total || ' episodes (' || CAST(round(n / total * 100) AS INTEGER) || '% co-occurrence rate).' AS content FROM co, total",
    ("co AS (SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(DISTINCT a.l_orderkey) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL HAVING count(DISTINCT a.l_orderkey) >= 30)", "total AS (SELECT count(DISTINCT l_orderkey) AS total FROM lineitem)"),
)
def o6_description(spark: SparkSession, d: str) -> DataFrame:
    co = observations.co_occurrence_patterns(tables.links(spark, d), least=30)
    return co.select("a", "b", observations.describe_co_occurrence(F.col("a").cast("string"), F.col("b").cast("string")).alias("content"))


@query("SELECT user_id, ts_text, n FROM (SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS ts_text, count(*) AS n FROM events GROUP BY ALL)")
def d6_fixed_windows(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = e.groupBy(F.window("ts", "1 hour").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("ts_text"), "n")


@query("SELECT DISTINCT l_orderkey AS episode_id, l_linenumber AS blob_index FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def d11_orphan_blobs(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("is_deleted"))
    b = tables.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("episode_id"), F.col("l_linenumber").alias("blob_index"))
    return ingest.orphan_blobs(b, e).distinct()


@query("SELECT user_id, event_id FROM events WHERE event_type = 'click'")
def p17_subscriptions(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "events").withColumn("events", F.concat(F.lit('["'), F.col("event_type"), F.lit('"]')))
    return upsert.subscribed(e, "click").select("user_id", "event_id")


@query(f"SELECT category, avg(hit) AS recall, count(*) AS questions FROM (SELECT id, source AS category, max(CASE WHEN contains(lower(content), 'the') THEN 1 ELSE 0 END) AS hit FROM docs GROUP BY ALL) GROUP BY 1", (DOCS,))
def a16_recall(spark: SparkSession, d: str) -> DataFrame:
    r = tables.read(spark, d, "documents").select(F.col("doc_id").alias("question_id"), F.col("source").alias("category"), F.lit(1).alias("rank"), F.col("text").alias("content"), F.array(F.lit("The")).alias("terms"))
    return aggregate.recall_at(r, 5)


@query()
def g6_communities(spark: SparkSession, d: str) -> DataFrame:
    return graph.communities(tables.entities(spark, d), tables.relationships(spark, d), 3)


@query()
def r15_context(spark: SparkSession, d: str) -> DataFrame:
    e = tables.episodes(spark, d)
    hits = retrieval.ranked(e.withColumn("score", F.lit(1.0)).orderBy("id").limit(3), 1).withColumn("position", F.col("rank"))
    return retrieval.context_text(episodes=hits)
