"""Queries of the fact store, aggregates and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.temporal import effective_at
from ..operators import aggregate, facts, ingest, paging, upsert
from ..sources import tables
from .registry import query, text, ts

AS_OF = "2024-01-15 00:00:00"
END = "2024-01-16 00:00:00"

FACTS = """facts AS (SELECT event_id AS id, user_id AS subject, event_type AS predicate, CAST(floor(value / 10) AS BIGINT) AS object, event_id % 50 AS source_episode_id,
  ts AS valid_from, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS valid_to,
  CASE WHEN event_type = 'error' AND value > 50 THEN ts END AS invalid_at, value FROM events)"""
EPISODES = """episodes AS (SELECT conv_id * 1000 + turn AS id, conv_id AS session_id, conv_id % 4 AS project_id, turn AS sequence_number, role, text AS content,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(conv_id * 60 + turn AS INTEGER)) AS created_at, CAST((conv_id * 7 + turn * 3) & 63 AS INTEGER) AS enrichment_status FROM conversations)"""
EDGES = """edges AS (SELECT 'c:' || o_custkey AS source_id, 's:' || l_suppkey AS target_id, 'bought_from' AS relationship_type, l_orderkey * 10 + l_linenumber AS id,
  least(o_orderdate, l_shipdate) AS valid_from, greatest(o_orderdate, l_shipdate) AS valid_to, l_quantity / 50 AS confidence FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
LIVE = f"(invalid_at IS NULL OR invalid_at > TIMESTAMP '{AS_OF}') AND (valid_from IS NULL OR valid_from <= TIMESTAMP '{AS_OF}') AND (valid_to IS NULL OR valid_to > TIMESTAMP '{AS_OF}')"
SHOW = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"
FACT_ROW = f"id, subject, predicate, object, {SHOW.format('valid_from')}, {SHOW.format('valid_to')}"


def _rows(df: DataFrame) -> DataFrame:
    return df.select("id", "subject", "predicate", "object", text("valid_from"), text("valid_to"))


@query(f"SELECT {FACT_ROW} FROM facts WHERE {LIVE}", (FACTS,))
def p1_effective_at(spark: SparkSession, d: str) -> DataFrame:
    return _rows(tables.facts(spark, d).where(effective_at(ts(AS_OF))))


@query(f"SELECT {FACT_ROW} FROM (SELECT * FROM facts WHERE {LIVE} ORDER BY valid_from DESC NULLS LAST, id LIMIT 50 OFFSET 10)", (FACTS,))
def p2_facts_at_time(spark: SparkSession, d: str) -> DataFrame:
    return _rows(facts.at_time(tables.facts(spark, d), ts(AS_OF), 50, 10))


@query(f"SELECT {FACT_ROW} FROM facts WHERE (invalid_at IS NULL OR invalid_at > TIMESTAMP '{AS_OF}') AND valid_from < TIMESTAMP '{END}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{AS_OF}')", (FACTS,))
def p3_facts_in_range(spark: SparkSession, d: str) -> DataFrame:
    return _rows(facts.in_range(tables.facts(spark, d), ts(AS_OF), ts(END)))


@query(f"SELECT {FACT_ROW} FROM facts WHERE {LIVE}", (FACTS,))
def p4_active_facts(spark: SparkSession, d: str) -> DataFrame:
    return _rows(facts.active(tables.facts(spark, d), ts(AS_OF)))


CONFLICT = "a.subject = b.subject AND a.predicate = b.predicate AND a.object = b.object AND a.id < b.id AND (b.valid_to IS NULL OR a.valid_from < b.valid_to) AND (a.valid_to IS NULL OR b.valid_from < a.valid_to)"
LONG = """long_facts AS (SELECT * REPLACE (valid_from + to_hours(72) AS valid_to) FROM facts)"""


def _long(spark: SparkSession, d: str) -> DataFrame:
    return tables.facts(spark, d).withColumn("valid_to", F.col("valid_from") + F.expr("interval 72 hours"))


@query(f"SELECT a.id AS a_id, b.id AS b_id, a.subject, a.predicate, a.object FROM long_facts a JOIN long_facts b ON {CONFLICT} AND a.source_episode_id <> b.source_episode_id", (FACTS, LONG))
def j11_overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    return facts.conflicts_across_episodes(_long(spark, d))


@query(f"SELECT a.id AS a_id, b.id AS b_id, a.subject, a.predicate, a.object, a.source_episode_id FROM long_facts a JOIN long_facts b ON {CONFLICT} AND a.source_episode_id = b.source_episode_id", (FACTS, LONG))
def j12_batch_overlap(spark: SparkSession, d: str) -> DataFrame:
    return facts.conflicts_in_episode(_long(spark, d))


@query(
    """SELECT id, 'invalid_range' AS issue, CAST(NULL AS DOUBLE) AS hours_ahead FROM raw WHERE valid_to < valid_from
    UNION ALL SELECT id, 'future_date', round(epoch_us(valid_from - TIMESTAMP '1998-06-01 00:00:00') / 3600000000.0, 1) FROM raw WHERE epoch_us(valid_from - TIMESTAMP '1998-06-01 00:00:00') / 3600000000.0 > 24""",
    ("raw AS (SELECT l_orderkey * 10 + l_linenumber AS id, o_orderdate AS valid_from, l_shipdate AS valid_to FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",),
)
def t7_range_checks(spark: SparkSession, d: str) -> DataFrame:
    o, li = tables.read(spark, d, "orders"), tables.read(spark, d, "lineitem")
    rows = li.join(o, li.l_orderkey == o.o_orderkey).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("o_orderdate").alias("valid_from"), F.col("l_shipdate").alias("valid_to"))
    return facts.range_checks(rows, ts("1998-06-01 00:00:00"))


@query(
    """SELECT event_id, user_id, content, strftime(ts, '%Y-%m-%d %H:%M:%S') AS valid_from, strftime(lead(ts) OVER w, '%Y-%m-%d %H:%M:%S') AS valid_to, lead(event_id) OVER w AS superseded_by
    FROM (SELECT *, lag(content) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM (SELECT *, event_type AS content FROM events))
    WHERE n = 1 OR before IS DISTINCT FROM content WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
)
def t1_supersession(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "events").withColumn("content", F.col("event_type"))
    return facts.supersede(e, ["user_id"], "content", "ts", "event_id").select("event_id", "user_id", "content", text("valid_from"), text("valid_to"), "superseded_by")


@query("SELECT user_id, event_type, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def a17_latest_row(spark: SparkSession, d: str) -> DataFrame:
    return tables.read(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS n FROM events) WHERE n = 1")
def w2_dedupe_rownum(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "events")
    return aggregate.latest(e, ["user_id"], [F.desc_nulls_last("value"), F.asc("event_id")]).select("event_id", "user_id", "event_type", "value")


HALF = "TIMESTAMP '1996-01-01 00:00:00'"


@query(
    """SELECT source_id, target_id, relationship_type, max(confidence) AS confidence, strftime(min(valid_from), '%Y-%m-%d %H:%M:%S') AS valid_from,
    strftime(CASE WHEN count(*) = count(end_at) THEN max(end_at) END, '%Y-%m-%d %H:%M:%S') AS valid_to FROM (SELECT *, CASE WHEN confidence < 0.9 THEN valid_to END AS end_at FROM edges) GROUP BY ALL""",
    (EDGES,),
)
def s9_edge_upsert(spark: SparkSession, d: str) -> DataFrame:
    e = tables.temporal_edges(spark, d).withColumn("valid_to", F.when(F.col("confidence") < 0.9, F.col("valid_to")))
    store, batch = e.where("id % 2 = 0"), e.where("id % 2 = 1")
    seeded = upsert.fold_edges(store, ts("2000-01-01 00:00:00")).withColumn("invalid_at", F.lit(None).cast("timestamp_ntz"))
    out = upsert.upsert_edges(seeded, batch, ts("2000-01-01 00:00:00"))
    return out.select(*upsert.EDGE_KEY, "confidence", text("valid_from"), text("valid_to"))


@query("SELECT source_id, target_id, relationship_type, max(confidence) AS confidence FROM edges GROUP BY ALL", (EDGES,))
def s10_bulk_edges(spark: SparkSession, d: str) -> DataFrame:
    e = tables.temporal_edges(spark, d)
    return upsert.bulk_edges(upsert.fold_edges(e.where("id % 2 = 0"), ts("2000-01-01 00:00:00")), e.where("id % 2 = 1"))


@query("SELECT user_id AS subject_entity_id, event_type AS observation_type, max_by(value, event_id) AS confidence FROM events GROUP BY ALL")
def s11_obs_upsert(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "events").select(F.lit(1).alias("project_id"), F.col("user_id").alias("subject_entity_id"), F.col("event_type").alias("observation_type"), F.lit(None).cast("long").alias("related_entity_id"), F.col("value").alias("confidence"), F.col("event_id").alias("at"))
    out = upsert.upsert_observations(e.where("at % 3 = 0"), e.where("at % 3 <> 0"))
    return out.select("subject_entity_id", "observation_type", "confidence")


@query("SELECT h, min(doc_id) AS doc_id FROM (SELECT doc_id, sha256(text) AS h FROM documents) GROUP BY h HAVING NOT bool_or(doc_id % 5 = 0)")
def s13_dedup_ledger(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return upsert.dedup_ledger(rows.where("doc_id % 5 = 0"), rows.where("doc_id % 5 <> 0"), ["h"], "doc_id").select("h", "doc_id")


@query("SELECT DISTINCT l_orderkey AS episode_id, l_suppkey AS entity_id FROM lineitem WHERE (l_orderkey, l_suppkey) NOT IN (SELECT (l_orderkey, l_suppkey) FROM lineitem WHERE l_linenumber = 1)")
def s12_link_insert(spark: SparkSession, d: str) -> DataFrame:
    li = tables.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("episode_id"), F.col("l_suppkey").alias("entity_id"), "l_linenumber")
    return upsert.insert_missing(li.where("l_linenumber = 1").distinct(), li.where("l_linenumber <> 1"), ["episode_id", "entity_id"]).select("episode_id", "entity_id")


@query("SELECT id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY sequence_number) + coalesce(last, -1) AS sequence_number FROM episodes LEFT JOIN (SELECT session_id, max(sequence_number) AS last FROM episodes WHERE sequence_number < 2 GROUP BY 1) USING (session_id) WHERE sequence_number >= 2", (EPISODES,))
def s7_append_sequence(spark: SparkSession, d: str) -> DataFrame:
    e = tables.episodes(spark, d)
    batch = e.where("sequence_number >= 2").withColumn("position", F.col("sequence_number")).drop("sequence_number")
    return upsert.with_sequence(e.where("sequence_number < 2"), batch).select("id", "session_id", F.col("sequence_number").cast("long").alias("sequence_number"))


@query("SELECT id, enrichment_status | coalesce(b, 0) AS enrichment_status FROM episodes LEFT JOIN (SELECT conv_id * 1000 + turn AS id, bit_or(CASE WHEN role = 'user' THEN 1 ELSE 16 END) AS b FROM conversations GROUP BY 1) USING (id)", (EPISODES,))
def s19_set_bits(spark: SparkSession, d: str) -> DataFrame:
    e = tables.episodes(spark, d)
    marks = e.select("id", F.when(F.col("role") == "user", 1).otherwise(16).alias("bit"))
    return upsert.set_bits(e, marks).select("id", "enrichment_status")


@query(
    """SELECT strftime(day, '%Y-%m-%d') AS day, coalesce(a.n, 0) AS events, coalesce(b.n, 0) AS errors FROM (SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY 1) a
    FULL JOIN (SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND event_type = 'error' GROUP BY 1) b USING (day)"""
)
def a2_daily_usage(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "events")
    return aggregate.daily_counts(e, e.where("event_type = 'error'"), "ts", ts("2024-01-10 00:00:00"), ("events", "errors"))


@query(
    """SELECT count(*) AS total, count(*) FILTER (created_at >= TIMESTAMP '2024-01-02 00:00:00') AS recent, count(*) FILTER (enrichment_status <> 63 AND enrichment_status <> 0) AS in_progress,
    count(*) FILTER (enrichment_status = 0) AS pending, count(*) FILTER (enrichment_status = 63) AS complete, round(100 * count(*) FILTER (enrichment_status = 63) / count(*), 1) AS pct_complete FROM episodes""",
    (EPISODES,),
)
def a3_status_dashboard(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.enrichment_dashboard(tables.episodes(spark, d), ts("2024-01-02 00:00:00"))


@query(
    """SELECT session_id, count(*) AS message_count, CAST(coalesce(sum(n), 0) AS BIGINT) AS fact_count, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_message_at, count(*) FILTER (enrichment_status <> 63) AS pending
    FROM episodes LEFT JOIN (SELECT event_id % 50 * 1000 AS id, count(*) AS n FROM events GROUP BY 1) USING (id) GROUP BY session_id""",
    (EPISODES,),
)
def a8_session_stats(spark: SparkSession, d: str) -> DataFrame:
    f = tables.facts(spark, d).withColumn("source_episode_id", F.col("source_episode_id") * 1000)
    return aggregate.session_stats(tables.episodes(spark, d), f).withColumn("last_message_at", text("last_message_at"))


@query(
    """SELECT user_id, count(*) FILTER (event_type <> 'error') AS messages, count(*) FILTER (value > 30) AS facts, count(*) FILTER (event_type = 'login') AS sessions FROM events GROUP BY user_id"""
)
def a10_user_stats(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "events")
    return aggregate.user_stats(e, e.where("event_type <> 'error'"), e.where("value > 30"), e.where("event_type = 'login'"), "user_id")


@query("SELECT user_id, event_type, k, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type, k) AS rank FROM (SELECT user_id, event_type, CAST(floor(value / 20) AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL)) WHERE rank <= 5")
def a12_top_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "events").withColumn("k", F.floor(F.col("value") / 20).cast("long"))
    return aggregate.top_pairs(e, ["user_id"], ["event_type", "k"])


@query("SELECT session_id, max(sequence_number) + 1 AS next_sequence FROM episodes GROUP BY 1", (EPISODES,))
def a7_next_sequence(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.next_sequence(tables.episodes(spark, d))


@query("SELECT c_nationkey AS project_id, coalesce(members, 0) AS members FROM (SELECT DISTINCT c_nationkey FROM customer) LEFT JOIN (SELECT s_nationkey AS c_nationkey, count(*) AS members FROM supplier GROUP BY 1) USING (c_nationkey)")
def a11_member_counts(spark: SparkSession, d: str) -> DataFrame:
    projects = tables.read(spark, d, "customer").select(F.col("c_nationkey").alias("project_id")).distinct()
    return aggregate.member_counts(projects, tables.read(spark, d, "supplier").select(F.col("s_nationkey").alias("project_id")))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def l1_topk(spark: SparkSession, d: str) -> DataFrame:
    return tables.read(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


PAGE = "SELECT {0}, (SELECT count(*) FROM orders WHERE {1}) > 40 AS has_more FROM orders WHERE {1} ORDER BY {2} LIMIT 40"


@query(PAGE.format("o_orderkey, o_custkey", "(o_orderdate, o_orderkey) > (TIMESTAMP '1995-06-01 00:00:00', 500)", "o_orderdate, o_orderkey"))
def l3_keyset_asc(spark: SparkSession, d: str) -> DataFrame:
    return paging.keyset_page(tables.read(spark, d, "orders"), [("o_orderdate", True), ("o_orderkey", True)], 40, [ts("1995-06-01 00:00:00"), 500]).select("o_orderkey", "o_custkey", "has_more")


@query(PAGE.format("o_orderkey, o_custkey", "(o_orderdate, o_orderkey) < (TIMESTAMP '1995-06-01 00:00:00', 500)", "o_orderdate DESC, o_orderkey DESC"))
def l4_keyset_desc(spark: SparkSession, d: str) -> DataFrame:
    return paging.keyset_page(tables.read(spark, d, "orders"), [("o_orderdate", False), ("o_orderkey", False)], 40, [ts("1995-06-01 00:00:00"), 500]).select("o_orderkey", "o_custkey", "has_more")


@query(PAGE.format("o_orderkey, o_custkey", "(o_custkey < 50 OR (o_custkey = 50 AND o_orderkey > 100))", "o_custkey DESC, o_orderkey"))
def l5_keyset_mixed(spark: SparkSession, d: str) -> DataFrame:
    return paging.keyset_page(tables.read(spark, d, "orders"), [("o_custkey", False), ("o_orderkey", True)], 40, [50, 100]).select("o_orderkey", "o_custkey", "has_more")


@query("SELECT id, content FROM episodes WHERE (sequence_number, id) > (1, 5001) ORDER BY sequence_number, id LIMIT 30", (EPISODES,))
def l6_episode_keyset(spark: SparkSession, d: str) -> DataFrame:
    return paging.keyset_page(tables.episodes(spark, d), [("sequence_number", True), ("id", True)], 30, [1, 5001]).select("id", "content")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey LIMIT 20 OFFSET 40")
def l7_offset(spark: SparkSession, d: str) -> DataFrame:
    return paging.offset_page(tables.read(spark, d, "customer"), [F.asc("c_name"), F.asc("c_custkey")], 3, 20).select("c_custkey", "c_name")


@query("SELECT id, role FROM episodes WHERE id <> 3000 ORDER BY created_at DESC, id DESC LIMIT 10", (EPISODES,))
def l9_recent_history(spark: SparkSession, d: str) -> DataFrame:
    return paging.recent_history(tables.episodes(spark, d), 3000).select("id", "role")


@query("SELECT event_id FROM events WHERE event_type <> 'error' AND CAST(json_extract_string(props, '$.k') AS INTEGER) = 7 AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-25 00:00:00'")
def p7_audit_filter(spark: SparkSession, d: str) -> DataFrame:
    logs = tables.read(spark, d, "events").select("event_id", F.col("event_type").alias("action"), "props", F.col("ts").alias("created_at"))
    return paging.audit_page(logs, {}, ("props", "$.k", 7), ("error",), ts("2024-01-05 00:00:00"), ts("2024-01-25 00:00:00")).select("event_id")


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '99') OR contains(lower(c_mktsegment), '99')")
def p5_ilike(spark: SparkSession, d: str) -> DataFrame:
    return paging.search_text(tables.read(spark, d, "customer"), ["c_name", "c_mktsegment"], "99").select("c_custkey", "c_name")


@query("SELECT id FROM facts WHERE source_episode_id IN (SELECT id // 1000 FROM episodes WHERE role = 'user')", (FACTS, EPISODES))
def j3_semi(spark: SparkSession, d: str) -> DataFrame:
    e = tables.episodes(spark, d).where("role = 'user'").select((F.col("id") / 1000).cast("long").alias("source_episode_id")).distinct()
    return tables.facts(spark, d).join(e, "source_episode_id", "left_semi").select("id")


@query("SELECT n_nationkey, n_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000)")
def j4_anti(spark: SparkSession, d: str) -> DataFrame:
    s = tables.read(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"))
    return tables.read(spark, d, "nation").join(s, "n_nationkey", "left_anti").select("n_nationkey", "n_name")


@query("SELECT r_name, n_name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def j2_three_way(spark: SparkSession, d: str) -> DataFrame:
    s, n, r = (tables.read(spark, d, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("suppliers"))


@query(
    """SELECT event_id, CAST(before AS BIGINT) AS before, before <= 3 AS allowed FROM (SELECT event_id,
    (SELECT count(*) FROM events b WHERE b.user_id = a.user_id AND b.ts >= a.ts - INTERVAL 6 HOURS AND (b.ts < a.ts OR (b.ts = a.ts AND b.event_id < a.event_id))) AS before FROM events a)"""
)
def d5_sliding_rate(spark: SparkSession, d: str) -> DataFrame:
    return ingest.sliding_rate(tables.read(spark, d, "events"), "user_id", "ts", "event_id", 6 * 3600, 3).select("event_id", F.col("before").cast("long").alias("before"), "allowed")


@query(
    """SELECT strftime(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2024-01-01 00:00:00'), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(count(*) / 21600.0, 9) AS rate, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1"""
)
def d7_quantiles(spark: SparkSession, d: str) -> DataFrame:
    out = aggregate.metric_quantiles(tables.read(spark, d, "events"), "ts", "value", [0.5, 0.95], 360)
    return out.select(text("start"), "n", F.round("rate", 9).alias("rate"), F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query(
    """SELECT id, stage FROM (SELECT * FROM episodes WHERE enrichment_status <> 63 AND created_at < TIMESTAMP '2024-01-03 00:00:00' ORDER BY created_at, id LIMIT 100),
    (VALUES ('classification', 1), ('entities', 2), ('facts', 4), ('structured', 8), ('embedding', 16), ('linking', 32)) t(stage, bit) WHERE enrichment_status & bit = 0""",
    (EPISODES,),
)
def d4_missing_stages(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.missing_stages(tables.episodes(spark, d), ts("2024-01-03 00:00:00"))


@query("SELECT id FROM facts WHERE predicate <> 'click' AND coalesce(value / 100, 0.5) >= 0.3 AND (valid_to IS NULL OR valid_from < valid_to)", (FACTS,))
def p9_complete_facts(spark: SparkSession, d: str) -> DataFrame:
    f = tables.facts(spark, d).withColumn("confidence", F.col("value") / 100).withColumn("predicate", F.when(F.col("predicate") != "click", F.col("predicate")))
    return facts.complete(f).select("id")


@query("SELECT user_id, count(*) AS n, sum(w) AS surviving FROM (SELECT user_id, event_type, 1 AS w FROM events GROUP BY ALL HAVING count(*) >= 5) GROUP BY user_id")
def w1_surviving_predicates(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")
    w = e.withColumn("surviving", F.count(F.lit(1)).over(Window.partitionBy("user_id")))
    return w.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("surviving").alias("surviving"))
