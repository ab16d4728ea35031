"""Queries of retrieval, graph, observations, ingest and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pii
from ..functions.text import STOP_WORDS, capitalised_words, identity_term, tokens
from ..operators import facts, graph, ingest, observations, retrieval, upsert
from ..sources import tables
from ..sources.staging import new_path
from ..streaming import jobs
from .registry import query, text, ts
from .temporal import EDGES, EPISODES, FACTS, LIVE, AS_OF

WORDS = "thanedble the"
LEXICAL = "thanedble"
K = 10


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return tables.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    row = tables.read(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()
    return list(row[0]) if row else [0.0] * 64


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return tables.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "source")


VECTOR = f"""vec AS (SELECT vec_id AS id, round(list_dot_product(CAST(embedding AS DOUBLE[]), q) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(q, q))), 9) AS score, label
  FROM embeddings, (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0))"""
STOP = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"
TOKENS = f"""tok AS (SELECT id, list_filter(string_split_regex(lower(content), '[^a-z0-9]+'), lambda x: x <> '' AND x NOT IN {STOP}) AS t FROM docs)"""
DOCS = "docs AS (SELECT doc_id AS id, text AS content, source FROM documents)"
BM25 = f"""lex AS (SELECT id, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / avg_len)), 9) AS score FROM
  (SELECT id, len(t) AS len, len(list_filter(t, lambda x: x = '{LEXICAL}')) AS f FROM tok), (SELECT count(*) AS n, avg(len(t)) AS avg_len, count(*) FILTER (list_contains(t, '{LEXICAL}')) AS df FROM tok) WHERE f > 0)"""


@query(f"SELECT id, score FROM vec ORDER BY score DESC, id LIMIT {K}", (VECTOR,))
def r1_vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.vector_topk(_vectors(spark, d), _query_vector(spark, d), K).select("id", "score")


@query(f"SELECT vec.id, score FROM vec JOIN facts ON vec.id = facts.id WHERE {LIVE} ORDER BY score DESC, vec.id LIMIT {K}", (VECTOR, FACTS))
def r2_vector_topk_asof(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d).join(tables.facts(spark, d), "id")
    return retrieval.vector_topk(rows, _query_vector(spark, d), K, as_of=ts(AS_OF)).select("id", "score")


@query(f"SELECT id, score FROM lex ORDER BY score DESC, id LIMIT {K}", (DOCS, TOKENS, BM25))
def r3_lexical_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.lexical_topk(_documents(spark, d), WORDS, K).select("id", "score")


FUSED = f"""legs AS (SELECT 1 AS l, id, row_number() OVER (ORDER BY score DESC, id) AS r FROM vec UNION ALL SELECT 2, id, row_number() OVER (ORDER BY score DESC, id) FROM lex),
  fused AS (SELECT id, round(sum(1 / (60 + r)), 6) AS rrf_score, min((l, r)) AS first FROM legs WHERE r <= {2 * K} GROUP BY id)"""


@query(f"SELECT id, rrf_score FROM fused ORDER BY rrf_score DESC, first, id LIMIT {K}", (VECTOR, DOCS, TOKENS, BM25, FUSED))
def r5_rrf(spark: SparkSession, d: str) -> DataFrame:
    v = retrieval.vector_topk(_vectors(spark, d), _query_vector(spark, d), 2 * K).select("id", "score")
    x = retrieval.lexical_topk(_documents(spark, d), WORDS, 2 * K).select("id", "score")
    return retrieval.rrf([retrieval.ranked(v, 1), retrieval.ranked(x, 2)], K).select("id", "rrf_score")


HYBRID_VECTOR = VECTOR.replace("vec AS", "vec0 AS") + ", vec AS (SELECT vec0.* FROM vec0 JOIN documents ON doc_id = id)"
HYBRID = FUSED.replace(str(2 * K), str(K))


@query(f"SELECT id, rrf_score, content FROM fused JOIN docs USING (id) ORDER BY rrf_score DESC, first, id LIMIT {K}", (HYBRID_VECTOR, DOCS, TOKENS, BM25, HYBRID))
def r6_hybrid(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    vectors = _vectors(spark, d).select("id", "embedding")
    rows = docs.join(vectors, "id", "left")
    found = retrieval.hybrid_search(rows, rows.withColumns({c: F.lit(None).cast("timestamp") for c in ("valid_from", "valid_to", "invalid_at")}), WORDS, _query_vector(spark, d), K, ts(AS_OF))
    return found["episodes"].select("id", "rrf_score", "content")


@query()
def r8_rerank(spark: SparkSession, d: str) -> DataFrame:
    hits = retrieval.lexical_topk(_documents(spark, d), LEXICAL, 50)
    return retrieval.rerank(hits, retrieval.overlap_scorer(LEXICAL)).select("id", "reranker_score")


GRAMS = """list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"""
SIMILARITY = "len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1})))"


@query(
    f"SELECT id, name, round(s, 6) AS similarity FROM (SELECT id, name, {SIMILARITY.format('a', 'b')} AS s FROM (SELECT p_partkey AS id, p_name AS name, {GRAMS.format('p_name')} AS a, {GRAMS.format(chr(39) + 'red widget' + chr(39))} AS b FROM part)) WHERE round(s, 6) > 0.3 ORDER BY similarity DESC, id LIMIT 50"
)
def r11_fuzzy_entities(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return retrieval.fuzzy_entities(e, "red widget").select("id", "name", "similarity")


@query(
    f"""SELECT id, name, round(0.6 * s + CASE WHEN contains(lower(summary), 'brand#1') THEN 0.4 ELSE 0 END, 6) AS score FROM (SELECT *, {SIMILARITY.format('a', 'b')} AS s FROM (SELECT p_partkey AS id, p_name AS name, '' AS summary, {GRAMS.format('p_name')} AS a, {GRAMS.format(chr(39) + 'red widget' + chr(39))} AS b FROM part))
    WHERE contains(lower(name), 'red widget') OR s > 0.2 ORDER BY score DESC, id LIMIT 20"""
)
def r10_entity_search(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("entity_type"), F.lit("").alias("summary"))
    return retrieval.search_entities(e, "red widget").select("id", "name", "score")


@query(
    """SELECT * FROM (SELECT 'customer' AS type, CAST(c_custkey AS VARCHAR) AS id, c_name AS label FROM customer WHERE contains(lower(c_name), '1') ORDER BY label, c_custkey LIMIT 4)
    UNION ALL SELECT * FROM (SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_name FROM supplier WHERE contains(lower(s_name), '1') ORDER BY s_name, s_suppkey LIMIT 4)
    UNION ALL SELECT * FROM (SELECT 'nation', CAST(n_nationkey AS VARCHAR), n_name FROM nation WHERE contains(lower(n_name), '1') ORDER BY n_name, n_nationkey LIMIT 4)"""
)
def u3_union_limited(spark: SparkSession, d: str) -> DataFrame:
    legs = {}
    for t, p in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("nation", "n_nationkey")):
        name = p[0] + "_name"
        legs[t] = (tables.read(spark, d, t).select(F.col(p).alias("id"), F.col(name).alias("label")), "label", ["label"])
    return retrieval.global_search(legs, "1", 12)


@query(f"SELECT 'Facts (' || count(*) || '):' || chr(10) || '{retrieval.SEPARATOR}' || chr(10) || string_agg('  ' || p || '. ' || event_type || ' [score=' || printf('%.4f', value) || ']', chr(10) ORDER BY p) AS text FROM (SELECT *, row_number() OVER (ORDER BY value DESC, event_id) AS p FROM events) WHERE p <= 5")
def t12_context_text(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "events").orderBy(F.desc("value"), "event_id").limit(5)
    rows = retrieval.ranked(e.select(F.col("event_id").alias("id"), F.col("event_type").alias("content"), F.col("value").alias("score")), 1)
    return retrieval.context_text(facts=rows.withColumn("position", F.col("rank")))


@query("SELECT '{\"entities\":[' || string_agg('{\"id\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}', ',' ORDER BY n_nationkey) || ']}' AS json FROM nation")
def t13_context_json(spark: SparkSession, d: str) -> DataFrame:
    n = tables.read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("position"))
    return retrieval.context_json(entities=n)


LOCATED = """located AS (SELECT 's:' || s_suppkey AS a, 'n:' || s_nationkey AS b FROM supplier UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey FROM customer UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey FROM nation)"""
BOTH = "pairs AS (SELECT a, b FROM {0} UNION SELECT b, a FROM {0})"


def _open(df: DataFrame) -> DataFrame:
    return df.withColumn("invalid_at", F.lit(None).cast("timestamp_ntz"))


@query("SELECT id, min(depth) AS depth FROM walk GROUP BY id", (LOCATED, BOTH.format("located"), "walk AS (SELECT 's:1' AS id, 0 AS depth UNION SELECT b, depth + 1 FROM walk JOIN pairs ON id = a WHERE depth < 3)"))
def g1_bfs(spark: SparkSession, d: str) -> DataFrame:
    seeds = spark.createDataFrame([("s:1",)], "id string")
    return graph.bfs(graph.live_edges(_open(tables.relationships(spark, d))), seeds, 3)


ASOF_EDGES = "open_edges AS (SELECT source_id AS a, target_id AS b FROM edges WHERE valid_from <= TIMESTAMP '1995-06-17 00:00:00' AND valid_to >= TIMESTAMP '1995-06-17 00:00:00')"


@query("SELECT id, min(depth) AS depth FROM walk GROUP BY id", (EDGES, ASOF_EDGES, BOTH.format("open_edges"), "walk AS (SELECT 's:1' AS id, 0 AS depth UNION SELECT b, depth + 1 FROM walk JOIN pairs ON id = a WHERE depth < 2)"))
def g2_bfs_asof(spark: SparkSession, d: str) -> DataFrame:
    e = tables.temporal_edges(spark, d)
    return graph.bfs(graph.live_edges(e, ts("1995-06-17 00:00:00")), spark.createDataFrame([("s:1",)], "id string"), 2)


@query()
def g4_retrieve_graph(spark: SparkSession, d: str) -> DataFrame:
    return graph.retrieve(tables.entities(spark, d).withColumn("summary", F.lit("")), _open(tables.relationships(spark, d)), "nation 3")


CO = "co AS (SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(DISTINCT a.l_orderkey) AS co_count FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL HAVING count(DISTINCT a.l_orderkey) >= 25)"


@query("SELECT * FROM co", (CO,))
def g14_cooccur(spark: SparkSession, d: str) -> DataFrame:
    return graph.co_occurrence(tables.links(spark, d), 25)


@query("SELECT a, b, co_count, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS total_episodes, round(least(co_count / 20, 1.0), 6) AS confidence FROM co", (CO,))
def o1_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return observations.co_occurrence_patterns(tables.links(spark, d), least=25)


ROUND = "l{1} AS (SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY n DESC, label) AS r FROM (SELECT around.id, label, count(*) AS n FROM around JOIN l{0} ON near = l{0}.id GROUP BY ALL)) WHERE r = 1)"


@query("SELECT id, label FROM l3", (LOCATED, BOTH.format("located"), "nodes AS (SELECT a AS id FROM pairs)", "around AS (SELECT a AS id, b AS near FROM pairs UNION SELECT id, id FROM nodes)", "l0 AS (SELECT DISTINCT id, id AS label FROM nodes)", *[ROUND.format(i, i + 1) for i in range(3)]))
def g5_communities(spark: SparkSession, d: str) -> DataFrame:
    e = tables.relationships(spark, d)
    nodes = e.select(F.col("source_id").alias("id")).union(e.select("target_id"))
    return graph.label_propagation(nodes, e, 3)


@query(
    """SELECT source_id, target_id, relationship_type, min(id) AS id FROM (SELECT id, CASE WHEN source_id IN ('c:1', 'c:2', 'c:4') THEN 'c:5' ELSE source_id END AS source_id, CASE WHEN target_id = 's:3' THEN 's:1' ELSE target_id END AS target_id, relationship_type FROM edges) GROUP BY ALL""",
    (EDGES,),
)
def g10_merge(spark: SparkSession, d: str) -> DataFrame:
    mapping = spark.createDataFrame([("c:1", "c:5"), ("c:2", "c:5"), ("c:4", "c:5"), ("s:3", "s:1")], "merged_id string, canonical_id string")
    _, edges, _ = graph.merge_entities(tables.entities(spark, d), tables.temporal_edges(spark, d), mapping)
    return edges.select("source_id", "target_id", "relationship_type", "id")


@query("SELECT DISTINCT 'u:' || user_id AS source_id, event_type AS relationship_type, 'k:' || json_extract_string(props, '$.k') AS target_id FROM events WHERE value > 50 AND event_type <> 'view'")
def g12_expiry(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "events")
    key = F.struct(F.concat(F.lit("u:"), F.col("user_id").cast("string")).alias("source_id"), F.col("event_type").alias("relationship_type"), F.concat(F.lit("k:"), F.get_json_object("props", "$.k")).alias("target_id"))
    events = e.select(F.when(F.col("value") > 50, "superseded").otherwise("same").alias("kind"), key.alias("old"), F.when(F.col("value") <= 50, key).alias("new"), "event_type").where("event_type <> 'view'")
    return graph.expiry_commands(events)


@query(
    f"""SELECT count(*) AS edges, count(*) FILTER (NOT live) AS expired FROM (SELECT user_id, event_type, k, bool_or(live) AS live FROM (SELECT user_id, event_type, json_extract_string(props, '$.k') AS k, coalesce(f.live, false) AS live FROM events LEFT JOIN
    (SELECT id, (invalid_at IS NULL OR invalid_at > TIMESTAMP '{AS_OF}') AND (valid_to IS NULL OR valid_to > TIMESTAMP '{AS_OF}') AS live FROM facts) f ON f.id = event_id) GROUP BY ALL)""",
    (FACTS,),
)
def g13_reconcile(spark: SparkSession, d: str) -> DataFrame:
    k = tables.read(spark, d, "events").select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").alias("object_entity_id"))
    f = tables.facts(spark, d).join(k, "id").withColumn("subject_entity_id", F.col("subject").cast("string"))
    edges = f.select(F.col("subject_entity_id").alias("source_id"), F.col("predicate").alias("relationship_type"), F.col("object_entity_id").alias("target_id")).distinct()
    done = graph.reconcile(_open(edges), f, ts(AS_OF))
    return done.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("invalid_at").isNotNull()).alias("expired"))


@query("SELECT DISTINCT o_custkey AS session_id, l_suppkey AS id, s_name AS name FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey")
def g15_session_entities(spark: SparkSession, d: str) -> DataFrame:
    episodes = tables.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("session_id"))
    s = tables.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("entity_type"))
    return graph.session_entities(episodes, tables.links(spark, d), s).select("session_id", "id", "name")


@query()
def g16_link_mentions(spark: SparkSession, d: str) -> DataFrame:
    e = tables.entities(spark, d)
    n = e.select(F.concat(F.lit("About "), F.initcap("name"), F.lit(".")).alias("content"), "id")
    return graph.link_mentions(n, e)


@query()
def g8_fuzzy_clusters(spark: SparkSession, d: str) -> DataFrame:
    p = tables.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_brand", "p_type").alias("name"))
    return graph.duplicate_clusters(p, 0.85)


GAPS = """gaps AS (SELECT user_id, ts, event_id, epoch_us(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 3600000000.0 AS gap, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  steps AS (SELECT user_id, gap, lag(gap) OVER (PARTITION BY user_id ORDER BY n) AS before FROM gaps WHERE gap >= 1),
  mono AS (SELECT user_id, count(*) AS gap_count, avg(gap) AS mean, CASE WHEN count(*) >= 2 THEN stddev_pop(gap) ELSE 0 END AS sd, min(gap) AS lo, max(gap) AS hi, count(before) AS steps, count(*) FILTER (gap > before) AS up, count(*) FILTER (gap < before) AS down FROM steps GROUP BY 1),
  alls AS (SELECT user_id, count(*) AS appearance_count, count(gap) AS all_gaps, count(*) FILTER (gap <= 6) AS short, count(*) FILTER (gap > 24) AS long, epoch_us(max(ts) - min(ts)) / 3600000000.0 / 24 AS span FROM gaps GROUP BY 1),
  kinds AS (SELECT *, CASE WHEN sd / mean < 0.25 AND gap_count >= 2 THEN 'periodic' WHEN gap_count >= 3 AND up / steps >= 0.6 THEN 'widening' WHEN gap_count >= 3 AND down / steps >= 0.6 THEN 'narrowing' WHEN all_gaps >= 3 AND short >= 2 AND long >= 1 THEN 'burst' ELSE 'irregular' END AS pattern_type FROM mono JOIN alls USING (user_id) WHERE appearance_count >= 3)"""


@query(
    """SELECT user_id, pattern_type, appearance_count, gap_count, round(mean, 2) AS mean_gap_hours, round(sd, 2) AS std_gap_hours, round(lo, 2) AS min_gap_hours, round(hi, 2) AS max_gap_hours, round(sd / mean, 4) AS cv, round(span, 1) AS span_days,
    CASE pattern_type WHEN 'periodic' THEN 0.85 WHEN 'widening' THEN 0.75 WHEN 'narrowing' THEN 0.7 WHEN 'burst' THEN 0.65 ELSE 0.4 END AS confidence FROM kinds""",
    (GAPS,),
)
def o2_temporal_gaps(spark: SparkSession, d: str) -> DataFrame:
    return observations.temporal_patterns(tables.read(spark, d, "events"), "user_id", "ts", "event_id")


@query(
    f"""SELECT subject, max_by(predicate, (n, -r)) AS top_predicate, max(n) AS top_count, count(*) AS total, string_agg(predicate || '(' || n || ')', ', ' ORDER BY n DESC, predicate) AS predicates, round(least(max(n) / count(*) * 1.5, 0.95), 2) AS confidence
    FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY predicate) AS r FROM (SELECT subject, predicate, count(*) AS n FROM facts WHERE (invalid_at IS NULL OR invalid_at > TIMESTAMP '{AS_OF}') AND valid_from <= TIMESTAMP '{AS_OF}' GROUP BY ALL HAVING count(*) >= 2)) GROUP BY subject""",
    (FACTS,),
)
def o5_behaviour(spark: SparkSession, d: str) -> DataFrame:
    return observations.behaviour_patterns(tables.facts(spark, d).withColumn("valid_to", F.lit(None).cast("timestamp_ntz")), ts(AS_OF))


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query(rf"SELECT doc_id, len(regexp_extract_all(text, '{EMAIL}')) AS emails FROM documents WHERE len(regexp_extract_all(text, '{EMAIL}')) > 0")
def i1_pii_counts(spark: SparkSession, d: str) -> DataFrame:
    found = tables.read(spark, d, "documents").select("doc_id", F.size(pii.matches(F.coalesce("text", F.lit("")), "email")).cast("long").alias("emails"))
    return found.where("emails > 0")


@query(rf"SELECT doc_id, sha256(regexp_replace(text, '{EMAIL}', '[REDACTED:EMAIL]', 'g')) AS masked FROM documents")
def i5_pii_mask(spark: SparkSession, d: str) -> DataFrame:
    passed, _ = ingest.apply_policy(tables.read(spark, d, "documents").select("doc_id", "text"), "mask", "text", ["email"])
    return passed.select("doc_id", F.sha2("text", 256).alias("masked"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_type || ' ' || p_brand), '[^a-z0-9\\s]', '', 'g')) AS term FROM part")
def f1_normalise(spark: SparkSession, d: str) -> DataFrame:
    return tables.read(spark, d, "part").select("p_partkey", identity_term(F.concat_ws(" ", "p_type", "p_brand")).alias("term"))


@query(f"SELECT id, len(t) AS n FROM tok", (DOCS, TOKENS))
def f3_analyzer(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("id", F.size(tokens(F.col("content"))).cast("long").alias("n"))


@query("SELECT id, array_to_string(list_transform(list_filter(string_split_regex(content, '[\\t\\n\\f\\r ]+'), lambda w: len(w) > 2 AND regexp_matches(w, '^[A-Z]')), lambda w: regexp_replace(w, '^[.,!?:;]+|[.,!?:;]+$', '', 'g')), ' ') AS words FROM episodes", (EPISODES,))
def f14_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tables.episodes(spark, d).select("id", F.array_join(capitalised_words(F.col("content")), " ").alias("words"))


@query("SELECT session_id, list_sort(list(DISTINCT role)) AS roles FROM (SELECT session_id, role FROM episodes UNION SELECT session_id, 'member' FROM episodes) GROUP BY 1", (EPISODES,))
def u1_union_distinct(spark: SparkSession, d: str) -> DataFrame:
    e = tables.episodes(spark, d)
    return e.select("session_id", "role").union(e.select("session_id", F.lit("member"))).distinct().groupBy("session_id").agg(F.array_sort(F.collect_list("role")).alias("roles"))


SCHEMA = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "enum": list(range(50))}}}


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) < 50 AS valid FROM events")
def f16_json_schema(spark: SparkSession, d: str) -> DataFrame:
    return ingest.validate_json(tables.read(spark, d, "events").select("event_id", "props"), "props", SCHEMA).select("event_id", "valid")


@query("SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY source_episode_id, subject, predicate, object ORDER BY event_id) AS n, bool_or(event_id % 7 = 0) OVER (PARTITION BY source_episode_id, subject, predicate, object) AS blocked FROM (SELECT event_id, event_id % 50 AS source_episode_id, user_id AS subject, event_type AS predicate, CAST(floor(value / 50) AS BIGINT) AS object FROM events)) WHERE event_id % 7 <> 0 AND NOT blocked AND n = 1")
def s16_exclusion(spark: SparkSession, d: str) -> DataFrame:
    f = tables.facts(spark, d).withColumn("object", F.floor(F.col("value") / 50).cast("long")).withColumn("valid_to", F.lit(None).cast("timestamp_ntz")).withColumn("invalid_at", F.lit(None).cast("timestamp_ntz"))
    return facts.exclude(f.where("id % 7 = 0"), f.where("id % 7 <> 0")).select(F.col("id").alias("event_id"))


@query("SELECT id, CASE WHEN a.user_id IS NULL THEN 'NEW' WHEN a.k = b.k THEN 'REPLAY' ELSE 'CONFLICT' END AS verdict FROM (SELECT event_id AS id, user_id, event_type AS k FROM events) b LEFT JOIN (SELECT user_id, min(event_type) AS k FROM events WHERE user_id % 2 = 0 GROUP BY 1) a USING (user_id)")
def d2_idempotency(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "events")
    ledger = e.where("user_id % 2 = 0").groupBy(F.col("user_id").alias("key")).agg(F.min("event_type").alias("body_hash")).withColumn("created_at", ts(AS_OF))
    batch = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.col("event_type").alias("body_hash"))
    return ingest.idempotency(batch, ledger, ts(AS_OF)).select("id", "verdict")


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def d1_stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Micro-batches of a file stream, appended idempotently."""
    folder = new_path(spark, "stream")
    step = jobs.append_batches(f"{folder}/out", lambda b: b.select("event_id", "user_id", "event_type"))
    jobs.run_batches(jobs.event_stream(spark, d), step, f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def d8_stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    folder = new_path(spark, "stream")
    stream = jobs.deduplicate(jobs.event_stream(spark, d).select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "60 days")
    jobs.run_available(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("user_id", "event_type")


@query("SELECT n_name AS name, n_regionkey AS type, coalesce(s, 'none') AS summary FROM nation LEFT JOIN (SELECT s_nationkey AS n_nationkey, max(s_name) AS s FROM supplier GROUP BY 1) USING (n_nationkey)")
def s8_entity_upsert(spark: SparkSession, d: str) -> DataFrame:
    n = tables.read(spark, d, "nation").select(F.lit(1).alias("organization_id"), F.lit(1).alias("project_id"), F.col("n_nationkey").alias("id"), F.lower("n_name").alias("name"), F.lit("Custom").alias("entity_type"), F.lit("none").alias("summary"))
    s = tables.read(spark, d, "supplier").select("s_nationkey", F.col("s_name").alias("summary")).join(tables.read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    batch = s.groupBy("n_nationkey", "n_name").agg(F.max("summary").alias("summary")).select(F.lit(1).alias("organization_id"), F.lit(1).alias("project_id"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("Custom").alias("entity_type"), "summary", F.lit(1).alias("at"))
    out = upsert.upsert_entities(n, batch)
    names = tables.read(spark, d, "nation").select(F.lower("n_name").alias("name"), F.col("n_name").alias("shown"), F.col("n_regionkey").alias("type"))
    return out.join(names, "name").select(F.col("shown").alias("name"), "type", "summary")


@query("SELECT old_id, strftime(at_time, '%Y-%m-%d %H:%M:%S') AS at_time FROM (SELECT id AS old_id, subject AS new_id, valid_to AS at_time FROM facts WHERE valid_to IS NOT NULL) WHERE old_id = 3 OR new_id = 3 ORDER BY at_time DESC, old_id LIMIT 20", (FACTS,))
def l10_lineage(spark: SparkSession, d: str) -> DataFrame:
    f = tables.facts(spark, d).where("valid_to is not null")
    events = f.select(F.col("id").alias("old_id"), F.col("subject").alias("new_id"), F.col("valid_to").alias("at_time"))
    return facts.lineage(events, 3, 20).select("old_id", text("at_time"))
