"""Operators on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import aggregate, facts, graph, ingest, observations, paging, retrieval, upsert

T = dt.datetime
def now():
    return F.lit(T(2024, 6, 1))


FACT = "organization_id int, id long, subject string, predicate string, object string, content string, subject_entity_id string, object_entity_id string, valid_from timestamp, valid_to timestamp, invalid_at timestamp"


def fact(i, content, s="Alice", p="likes", o="hiking", org=1, ids=(None, None), start=None, end=None, invalid=None):
    return (org, i, s, p, o, content, *ids, start, end, invalid)


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


# fusion


def ranked(spark, *lists):
    return [spark.createDataFrame([(n, r, i, f"c{n}{i}") for r, i in enumerate(ids, 1)], "list_no int, rank int, id string, content string") for n, ids in enumerate(lists, 1)]


def test_rrf(spark):
    out = retrieval.rrf(ranked(spark, ["dup"], ["dup", "other"]), 10).collect()
    assert [(r["id"], r["rrf_score"], r["content"]) for r in out] == [("dup", round(2 / 61, 6), "c1dup"), ("other", round(1 / 62, 6), "c2other")]
    assert [r["id"] for r in retrieval.rrf(ranked(spark, "abc", "bde"), 9).collect()][0] == "b"
    assert [r["id"] for r in retrieval.rrf(ranked(spark, "abcdefghij", "abcdefghij"), 3).collect()] == ["a", "b", "c"]
    assert retrieval.rrf(ranked(spark, ["x"])[:1], 5).count() == 1
    assert retrieval.rrf([ranked(spark, ["x"])[0].limit(0)], 5).count() == 0


def test_lexical_needs_all_terms(spark):
    df = spark.createDataFrame([(1, "red apple pie"), (2, "red car"), (3, "apple apple red"), (4, None)], "id int, content string")
    assert [r["id"] for r in retrieval.lexical_topk(df, "the red apple", 5).collect()] == [3, 1]
    assert retrieval.lexical_topk(df, "the of", 5).count() == 0 and retrieval.lexical_topk(df, "red boat", 5).count() == 0


def test_vector_topk(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0]), (5, [1.0, 0.0])], "id int, embedding array<float>")
    assert [r["id"] for r in retrieval.vector_topk(df, [1.0, 0.1], 3).collect()] == [1, 5, 2]


def test_rerank(spark):
    df = spark.createDataFrame([(1, "cat"), (2, ""), (3, "cat dog"), (4, None)], "id int, content string")
    out = retrieval.rerank(df, retrieval.overlap_scorer("cat dog"), 3).collect()
    assert [(r["id"], r["reranker_score"]) for r in out] == [(3, 1.0), (1, 0.5), (2, 0.0)]


def test_similar_pairs_matches_all_pairs(spark):
    names = ["alpha beta", "alpha betta", "gamma", "gama", "alpha", "delta one", "delta two", "x"]
    df = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    every = df.alias("a").join(df.alias("b"), F.col("a.id") < F.col("b.id")).select(F.col("a.id"), F.col("b.id"), F.round(retrieval.trigram_similarity(F.col("a.name"), F.col("b.name")), 6).alias("s")).where("s > 0.4")
    assert rows(retrieval.similar_pairs(df, 0.4)) == rows(every)


def test_context(spark):
    e = spark.createDataFrame([(1, "user", "hello\nyou", 0.5)], "position int, role string, content string, score double")
    f = spark.createDataFrame([(2, "second", None, None), (1, "first", 0.9, T(2026, 1, 1))], "position int, content string, confidence double, valid_from timestamp")
    line = retrieval.SEPARATOR
    want = f"Recent Episodes (1):\n{line}\n  1. [user] [score=0.5000]\n    hello\n    you\n\n\nFacts (2):\n{line}\n  1. first (valid: from 2026-01-01) (confidence=0.90)\n  2. second"
    assert retrieval.context_text(episodes=e, facts=f).first()[0] == want
    assert retrieval.context_text(facts=f.limit(0)).first()[0] == "No context found."
    assert retrieval.context_json(facts=f).first()[0] == '{"facts":[{"content":"first","confidence":0.9,"valid_from":"2026-01-01T00:00:00.000Z"},{"content":"second"}]}'


# facts


def test_supersession_batches(spark):
    t0 = T(2024, 1, 1)
    store = spark.createDataFrame([fact(1, "Alice likes hiking", start=t0), fact(2, "other org", org=2, start=t0), fact(3, "kept", s="Bob", start=t0)], FACT)
    batch = spark.createDataFrame([fact(10, "Alice absolutely loves hiking"), fact(11, "Alice absolutely loves hiking"), fact(12, "kept", s="bob!"), fact(13, "new", s="Eve")], FACT)
    new, inserted, events = facts.ingest(store, batch, now())
    assert rows(inserted, "id") == [(10,), (13,)]
    assert rows(events, "old_id", "new_id", "kind") == [(1, 10, "superseded")]
    closed = {r["id"]: r["valid_to"] for r in new.collect()}
    assert closed[1] == T(2024, 6, 1) and closed[2] is None and closed[3] is None and closed[10] is None
    assert rows(facts.ingest(new, batch, F.lit(T(2024, 7, 1)))[1], "id") == []


def test_identity_by_entity(spark):
    store = spark.createDataFrame([fact(1, "a", ids=("e1", "e2"), start=T(2024, 1, 1)), fact(2, "b", start=T(2024, 1, 1))], FACT)
    batch = spark.createDataFrame([fact(5, "c", s="Al", ids=("e1", "e2"))], FACT)
    assert rows(facts.ingest(store, batch, now())[2], "old_id", "new_id") == [(1, 5)]


def test_several_contents_of_one_batch(spark):
    batch = spark.createDataFrame([fact(1, "A"), fact(2, "B"), fact(3, "A")], FACT)
    new, inserted, events = facts.ingest(batch.limit(0), batch, now())
    assert rows(inserted, "id") == [(1,), (2,)] and rows(events, "old_id", "new_id") == [(1, 2)]
    assert rows(new.where(facts.effective_at(F.lit(T(2024, 6, 2)))), "content") == [("B",)]


EX = "id int, source_episode_id int, subject string, predicate string, object string, valid_from timestamp, valid_to timestamp, invalid_at timestamp"


def test_exclusion(spark):
    def row(i, start, end, episode=1, invalid=None, o="o"):
        return (i, episode, "s", "p", o, start, end, invalid)

    a, b, c, d = (T(2024, m, 1) for m in (1, 2, 3, 4))
    store = spark.createDataFrame([row(1, a, b), row(2, c, d, invalid=d)], EX)
    batch = spark.createDataFrame([row(10, a, c), row(11, b, c), row(12, b, d), row(13, c, d), row(14, a, b, o="x"), row(15, a, b, episode=None), row(16, a, c, episode=None), row(17, b, a), row(18, None, None, episode=3), row(19, a, b, episode=3)], EX)
    assert [r[0] for r in rows(facts.exclude(store, batch), "id")] == [11, 13, 14, 15, 16, 18]


def test_retract_is_idempotent(spark):
    store = spark.createDataFrame([fact(1, "a"), fact(2, "b", end=T(2024, 2, 1)), fact(3, "c", invalid=T(2024, 2, 1)), fact(4, "d")], FACT)
    new, events = facts.retract(store, spark.createDataFrame([(1,), (1,), (2,), (3,)], "id long"), now())
    assert rows(events, "old_id", "kind") == [(1, "retracted")]
    assert {r["id"]: r["invalid_at"] for r in new.collect()} == {1: T(2024, 6, 1), 2: None, 3: T(2024, 2, 1), 4: None}


def test_invalidate_by_reference(spark):
    store = spark.createDataFrame([fact(1, "a"), fact(2, "b", end=T(2024, 2, 1))], FACT)
    refs = spark.createDataFrame([("E1", 1), ("E2", 2)], "ref string, id long")
    cmds = spark.createDataFrame([("E1", "wrong"), ("E2", "late"), ("N9", "?")], "ref string, reason string")
    _, events, unknown = facts.invalidate(store, refs, cmds, now())
    assert rows(events, "old_id", "reason") == [(1, "wrong")] and rows(unknown, "ref") == [("N9",)]


def test_synonyms(spark):
    cols = "id int, subject string, predicate string, object string"
    store = spark.createDataFrame([(1, "Al", "works_at", "Acme")], cols)
    batch = spark.createDataFrame([(2, "al ", "Employed_By", "ACME"), (3, "al", "likes", "acme"), (4, "bo", "works_at", "acme")], cols)
    assert [r[0] for r in rows(facts.without_synonyms(batch, store), "id")] == [3, 4]


def test_conflict_candidates_and_names(spark):
    store = spark.createDataFrame([fact(1, "a", ids=("x", "y")), fact(2, "b", s="ALICE"), fact(3, "c", p="hates")], FACT)
    batch = spark.createDataFrame([fact(9, "n", s="alice", ids=("x", "y"))], FACT)
    assert rows(facts.conflict_candidates(batch, store, now())) == [(9, 1), (9, 2)]
    people = spark.createDataFrame([("p1", "Bob", "Person", 0), ("p2", "Acme Corp", "Org", 1), ("p3", "Bobby", "Person", 2)], "id string, name string, entity_type string, position int")
    named = spark.createDataFrame([("me",), ("bobby",), ("acme",), ("the acme corp office",), ("acme, corp",), ("zed",)], "subject string")
    got = dict(rows(facts.resolve_names(named, people, "subject", "e").where("e is not null"), "subject", "e"))
    assert got == {"me": "p1", "bobby": "p3", "acme": "p2", "the acme corp office": "p2", "acme, corp": "p2"}


# edges and upserts


@pytest.mark.parametrize(("old", "new", "want"), [(None, None, None), (6, None, None), (None, 12, None), (6, 12, 12), (12, 6, 12), (6, 6, 6)])
def test_edge_valid_to_merge(spark, old, new, want):
    def edge(m, c):
        return spark.createDataFrame([("a", "b", "t", c, T(2024, 1, 1), T(2024, m, 1) if m else None, None)], "source_id string, target_id string, relationship_type string, confidence double, valid_from timestamp, valid_to timestamp, invalid_at timestamp")

    r = upsert.upsert_edges(edge(old, 0.5), edge(new, 0.4), now()).first()
    assert r["valid_to"] == (T(2024, want, 1) if want else None) and r["confidence"] == 0.5


def test_entity_upsert(spark):
    cols = "organization_id int, project_id int, id int, name string, entity_type string, summary string, at int"
    store = spark.createDataFrame([(1, 1, 1, "alice", "Custom", "s", 0), (1, 1, 2, "acme", "Org", None, 0), (1, 2, 3, "alice", "Person", None, 0)], cols).drop("at")
    batch = spark.createDataFrame([(1, 1, 9, " Alice", "Person", "", 1), (1, 1, 8, "ACME", "Person", "new", 2), (1, 1, 7, "bob", "Custom", None, 3)], cols)
    assert rows(upsert.upsert_entities(store, batch).na.fill("-"), "id", "entity_type", "summary", "action") == [(1, "Person", "s", "updated"), (2, "Org", "new", "updated"), (3, "Person", "-", "existing"), (7, "Custom", "-", "created")]


def test_merge_patch(spark):
    df = spark.createDataFrame([('{"a":1,"b":{"x":1,"y":2},"c":"q"}', '{"a":null,"b":{"y":3},"d":[1]}'), (None, '{"k":"v"}')], "o string, p string")
    got = [r[0] for r in df.select(upsert.merge_patch(F.col("o"), F.col("p"))).collect()]
    assert got == [{"b": '{"x":"1","y":"3"}', "c": "q", "d": "[1]"}, {"k": "v"}]


def test_sequence_versions_and_ledger(spark):
    store = spark.createDataFrame([(1, 0), (1, 4)], "session_id int, sequence_number int")
    batch = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "session_id int, position int")
    assert rows(upsert.with_sequence(store, batch), "session_id", "sequence_number") == [(1, 5), (1, 6), (2, 0)]
    old = spark.createDataFrame([("t", 1, "a", True, True)], "name string, version int, body string, is_active boolean, is_default boolean")
    new = spark.createDataFrame([("t", "b", 1), ("u", "c", 1)], "name string, body string, position int")
    assert rows(upsert.new_versions(old, new), "name", "version", "is_active", "is_default") == [("t", 1, False, False), ("t", 2, True, True), ("u", 1, True, False)]


def test_subscriptions_and_classification(spark):
    ends = spark.createDataFrame([(1, "[]"), (2, '["a"]'), (3, '["b"]'), (4, "oops"), (5, None)], "id int, events string")
    assert rows(upsert.subscribed(ends, "a"), "id") == [(1,), (2,)]
    cols = "organization_id int, episode_id int, intent string, emotion string, valence string, arousal string, confidence double"
    got = upsert.classification_rows(spark.createDataFrame([(1, 1, "ask", "odd", "positive", "huge", 1.7), (1, 2, "ask", "joy", "x", "low", -1.0)], cols), spark.createDataFrame([(1, 2, None, None, None, None, None)], cols), ["ask"], ["joy"])
    assert rows(got) == [(1, 1, "ask", None, "positive", None, 1.0)]


# pages


def test_keyset_pages_cover_all_rows_once(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(10)], "a int, id int")
    order, last, seen = [("a", False), ("id", True)], None, []
    while True:
        page = sorted(paging.keyset_page(df, order, 4, last).collect(), key=lambda r: (-r["a"], r["id"]))
        seen += [(r["a"], r["id"]) for r in page]
        if not page[0]["has_more"]:
            break
        last = [page[-1]["a"], page[-1]["id"]]
    assert seen == sorted(((i % 3, i) for i in range(10)), key=lambda x: (-x[0], x[1]))


# graph


def edges(spark, pairs):
    return spark.createDataFrame([(i, a, b, "t", None, None, None) for i, (a, b) in enumerate(pairs)], "id int, source_id int, target_id int, relationship_type string, valid_from timestamp, valid_to timestamp, invalid_at timestamp")


def test_bfs(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 4), (4, 1), (9, 9), (5, 4)])
    seed = spark.createDataFrame([(1,)], "id int")
    assert rows(graph.bfs(e, seed, 2)) == [(1, 0), (2, 1), (3, 2), (4, 1), (5, 2)]
    assert rows(graph.bfs(e, seed, 1, "out")) == [(1, 0), (2, 1)]
    assert rows(graph.bfs(graph.live_edges(e, types=[]), seed, 2)) == [(1, 0)]


def test_communities(spark):
    nodes = spark.createDataFrame([(i, f"n{i}") for i in range(1, 8)], "id int, name string")
    e = edges(spark, [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (7, 99)])
    labels = dict(rows(graph.label_propagation(nodes, e)))
    assert len({labels[i] for i in (1, 2, 3)}) == 1 and len({labels[i] for i in (4, 5, 6)}) == 1 and labels[1] != labels[4]
    assert rows(graph.communities(nodes, e), "member_count", "name") == [(3, "n1, n2, n3"), (3, "n4, n5, n6")]


def test_merge(spark):
    e = edges(spark, [(1, 3), (2, 3), (3, 2), (2, 1)])
    entities = spark.createDataFrame([(1, "a"), (2, "A"), (3, "c")], "id int, name string")
    mapping = spark.createDataFrame([(2, 1)], "merged_id int, canonical_id int")
    flagged, kept, counts = graph.merge_entities(entities, e, mapping)
    assert rows(kept, "source_id", "target_id") == [(1, 1), (1, 3), (3, 1)] and rows(flagged.where("is_merged"), "id") == [(2,)]
    assert tuple(counts.first()) == (3, 1)
    assert rows(graph.merge_entities(entities, e, mapping, True)[1], "source_id", "target_id") == [(1, 3), (3, 1)]


def test_duplicate_clusters(spark):
    names = ["Acme Corporation", "acme corporation ", "Acme Corporations", "Zeta", "Beta"]
    df = spark.createDataFrame([(f"e{i}", n) for i, n in enumerate(names)], "id string, name string")
    got = dict(rows(graph.duplicate_clusters(df, 0.8)))
    assert got["e0"] == got["e1"] == got["e2"] and len({got["e0"], got["e3"], got["e4"]}) == 3


def test_reconcile(spark):
    e = edges(spark, [(1, 2), (3, 4), (5, 6), (7, 8), (9, 10)])
    f = "subject_entity_id int, predicate string, object_entity_id int, valid_from timestamp, valid_to timestamp, invalid_at timestamp"
    past, future = T(2024, 1, 1), T(2025, 1, 1)
    store = spark.createDataFrame([(1, "t", 2, None, None, None), (3, "t", 4, None, past, None), (5, "t", 6, None, future, None), (7, "t", 8, future, None, None)], f)
    assert rows(graph.orphans(e, store, now()), "id") == [(1,), (4,)]
    assert rows(graph.reconcile(e, store, now()).where("invalid_at is not null"), "id") == [(1,), (4,)]


# observations


def test_observations(spark):
    links = spark.createDataFrame([(i, "X") for i in range(5)] + [(i, "Y") for i in (0, 2, 4)] + [(i, "Z") for i in (1, 3)], "episode_id int, entity_id string")
    assert rows(observations.co_occurrence_patterns(links), "a", "b", "co_count", "total_episodes", "confidence") == [("X", "Y", 3, 5, 0.15)]
    seen = links.select("entity_id", F.expr("timestamp'2024-01-01' + make_dt_interval(7 * episode_id)").alias("ts"), "episode_id")
    got = {r["entity_id"]: r for r in observations.temporal_patterns(seen, "entity_id", "ts", "episode_id").collect()}
    assert set(got) == {"X", "Y"} and got["X"]["pattern_type"] == "periodic" and got["X"]["mean_gap_hours"] == 168 and got["X"]["span_days"] == 28 and got["X"]["confidence"] == 0.85
    f = [("X", "asked_about_pricing")] * 3 + [("X", "requested_demo")] * 2 + [("Y", "churned")] * 2
    store = spark.createDataFrame([(s, p, None, None, None) for s, p in f], "subject string, predicate string, valid_from timestamp, valid_to timestamp, invalid_at timestamp")
    parity = {r["subject"]: (r["total"], r["confidence"]) for r in observations.behaviour_patterns(store, now()).collect()}
    assert parity["X"] == (2, 0.95)
    assert {r["subject"]: (r["total"], r["confidence"]) for r in observations.behaviour_patterns(store, now(), corrected=True).collect()}["X"] == (5, 0.9)


@pytest.mark.parametrize(("hours", "want"), [([0, 2, 6, 20, 60], "widening"), ([0, 40, 54, 58, 60], "narrowing"), ([0, 1, 2, 3, 40, 41, 42], "burst"), ([0, 5], None)])
def test_temporal_classes(spark, hours, want):
    df = spark.createDataFrame([("e", i, h) for i, h in enumerate(hours)], "e string, i int, h int").withColumn("ts", F.expr("timestamp'2024-01-01' + make_dt_interval(0, h)"))
    got = [r["pattern_type"] for r in observations.temporal_patterns(df, "e", "ts", "i").collect()]
    assert got == ([want] if want else [])


# ingest


def test_ingest_batch(spark):
    batch = spark.createDataFrame([(1, 1, 0, "user", "mail a@b.org"), (1, 1, 1, "user", "mail a@b.org"), (1, 1, 2, "user", "hi")], "project_id int, session_id int, position int, role string, content string")
    ledger = spark.createDataFrame([], "project_id int, session_id int, content_hash string")
    store = spark.createDataFrame([(1, 3)], "session_id int, sequence_number int")
    out = ingest.ingest(batch, store, ledger)
    assert rows(out["episodes"], "sequence_number", "content") == [(4, "mail [REDACTED:EMAIL]"), (5, "hi")]
    assert out["jobs"].count() == 6 and ingest.ingest(batch, store, out["ledger"])["episodes"].count() == 0
    passed, rejected = ingest.apply_policy(batch, "block")
    assert passed.count() == 1 and rejected.count() == 2 and ingest.apply_policy(batch, "off")[0].count() == 3


def test_sliding_rate_counts_the_window_before(spark):
    df = spark.createDataFrame([("u", i, s) for i, s in enumerate([0, 0, 1, 2, 30])], "k string, i int, s int").withColumn("ts", F.expr("timestamp'2024-01-01' + make_dt_interval(0, 0, 0, s)"))
    assert rows(ingest.sliding_rate(df, "k", "ts", "i", 10, 2), "i", "before", "allowed") == [(0, 0, True), (1, 1, True), (2, 2, True), (3, 3, False), (4, 0, True)]


def test_json_schema():
    schema = {"type": "object", "required": ["a", "b"], "properties": {"a": {"type": "integer"}, "b": {"enum": ["x"], "default": "x"}, "c": {"type": "array", "items": {"type": "string"}}}}
    assert ingest.schema_errors(schema, ingest.with_defaults(schema, {"a": 1})) == []
    assert ingest.schema_errors(schema, {"a": True, "b": "y", "c": ["s", 2]}) == ["$.a: not of type integer", "$.b: not in enum", "$.c[1]: not of type string"]


def test_blob_text_and_filters(spark):
    blobs = spark.createDataFrame([("a", "text/plain", bytearray(b"ok \xff")), ("b", "image/png", bytearray(b"x"))], "path string, mime string, content binary")
    assert rows(ingest.extract_text(blobs).na.fill("-"), "path", "extracted_text") == [("a", "ok �"), ("b", "-")]
    e = spark.createDataFrame([("She", "Person", ""), ("acme", "Weird", ""), ("bob", "Person", "Bobby")], "name string, entity_type string, mention string")
    assert rows(ingest.entity_filter(e, ["Person"]), "display", "entity_type") == [("Acme", "Custom"), ("Bobby", "Person")]


def test_daily_counts_and_recall(spark):
    a = spark.createDataFrame([(T(2024, 1, 1, 5),), (T(2024, 1, 2),)], "ts timestamp")
    b = spark.createDataFrame([(T(2024, 1, 3),)], "ts timestamp")
    assert [tuple(r) for r in aggregate.daily_counts(a, b, "ts", F.lit(T(2023, 1, 1)), ("x", "y")).collect()] == [("2024-01-03", 0, 1), ("2024-01-02", 1, 0), ("2024-01-01", 1, 0)]
    res = spark.createDataFrame([(1, "c", 1, "Blue Sky", ["blue"]), (1, "c", 2, "x", ["blue"]), (2, "c", 3, "blue", ["blue"])], "question_id int, category string, rank int, content string, terms array<string>")
    assert rows(aggregate.recall_at(res, 2)) == [("c", 0.5, 2)]


def test_event_stream_of_part_files(spark, tmp_path):
    from mnemospark.streaming import jobs

    spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(90).repartition(3).write.parquet(f"{tmp_path}/t/events.parquet")
    jobs.run_available(jobs.event_stream(spark, f"{tmp_path}/t"), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 90


# the graph as one object


def test_graph_store(spark):
    from mnemospark.operators.store import GraphStore

    t = "timestamp_ntz"
    entities = spark.createDataFrame([(1, 1, i, n, "Custom", "") for i, n in ((1, "ann"), (2, "bob"), (3, "carl"))], "organization_id int, project_id int, id int, name string, entity_type string, summary string")
    edges = spark.createDataFrame([(10, 1, 2, "knows", 0.5, 1), (11, 2, 3, "knows", 0.5, 2), (12, 3, 3, "is", 0.5, 3)], "id int, source_id int, target_id int, relationship_type string, confidence double, created_at int")
    edges = edges.withColumns({c: F.lit(None).cast(t) for c in ("valid_from", "valid_to", "invalid_at")})
    links = spark.createDataFrame([(100, 1), (100, 2)], "episode_id int, entity_id int")
    episodes = spark.createDataFrame([(100, 7, 5)], "id int, session_id int, created_at int")
    store = GraphStore(entities, edges, links, episodes)
    seeds = spark.createDataFrame([(1,)], "id int")
    assert store.healthy() and not GraphStore(entities, spark.range(1).selectExpr("raise_error('x') AS id")).healthy()
    assert {r["id"]: r["depth"] for r in store.traverse(seeds, 2).collect()} == {1: 0, 2: 1, 3: 2}
    assert [r["id"] for r in store.list_edges(2).collect()] == [11, 10]
    assert [r["id"] for r in store.list_edges(2, last=[2, 11]).collect()] == [10]
    gone = store.expire_edge(11, F.expr("timestamp_ntz'2024-01-01 00:00:00'"))
    assert {r["id"] for r in gone.all_edges().collect()} == {10, 12} and store.all_edges().count() == 3
    assert {r["id"] for r in store.delete_entity(2).all_edges().collect()} == {12}
    assert {r["id"] for r in store.session_entities(7).collect()} == {1, 2}
    linked = store.link(spark.createDataFrame([(100, 1), (100, 3)], "episode_id int, entity_id int"))
    assert linked.links.count() == 3 and linked.linked_episodes().first()[0] == 1
    merged = store.merge(spark.createDataFrame([(3, 2)], "merged_id int, canonical_id int"))
    assert {r["id"] for r in merged.list_entities().collect()} == {1, 2}
    batch = spark.createDataFrame([(1, 1, 4, "Dora ", "Person", "new", 1)], "organization_id int, project_id int, id int, name string, entity_type string, summary string, at int")
    assert [r["name"] for r in store.create_entities(batch).list_entities(["Person"]).collect()] == ["dora"]


def test_effects_and_status(spark):
    from mnemospark.operators import effects

    changes = spark.createDataFrame([(1, "fact", "retracted", 5), (1, "fact", "looked at", 6), (2, "user", "created", 7)], "organization_id int, what string, happened string, id int")
    got = {(r["organization_id"], r["effect"], r["event_type"], r["id"]) for r in effects.effects(changes).collect()}
    assert got == {(1, "webhook", "fact.retracted", "5"), (1, "purge", None, "context:*"), (2, "webhook", "user.created", "7")}
    rows = [(1, "ok"), (1, "ok"), (2, "ok"), (2, "failed"), (3, "failed"), (4, "skipped")]
    status = effects.job_status(spark.createDataFrame(rows, "org int, outcome string"), ["org"])
    assert {r["org"]: r["status"] for r in status.collect()} == {1: "completed", 2: "partial", 3: "error", 4: "skipped"}


def test_resolve_names_by_scope(spark):
    from mnemospark.operators import facts

    entities = spark.createDataFrame([(1, 10, "New York City", "Place", 0), (1, 11, "York", "Place", 1), (1, 12, "Sam", "Person", 2), (2, 20, "York", "Place", 0)], "project_id int, id int, name string, entity_type string, position int")
    asked = [(1, "york"), (1, "in york today"), (1, "new york"), (1, "N.E.W york city"), (1, "me"), (2, "york"), (2, "me"), (1, "yo"), (1, None)]
    out = facts.resolve_names(spark.createDataFrame(asked, "project_id int, subject string"), entities, "subject", "e", ["project_id"])
    got = {(r["project_id"], r["subject"]): r["e"] for r in out.collect()}
    assert got == {(1, "york"): 11, (1, "in york today"): 11, (1, "new york"): 11, (1, "N.E.W york city"): 11, (1, "me"): 12, (2, "york"): 20, (2, "me"): None, (1, "yo"): None, (1, None): None}


def test_large_episode_pairs(spark, monkeypatch):
    from mnemospark.operators import graph

    monkeypatch.setattr(graph, "LARGE_EPISODE", 3)
    links = spark.createDataFrame([(e, x) for e in (1, 2) for x in range(5)] + [(3, 0), (3, 1), (3, 1)], "episode_id int, entity_id int")
    got = {(r["a"], r["b"]): r["co_count"] for r in graph.co_occurrence(links, 2).collect()}
    assert got == {(a, b): 2 + (a == 0 and b == 1) for a in range(5) for b in range(a + 1, 5)}


def test_resolve_names_without_pairs(spark):
    from mnemospark.operators import facts

    names = ["Account 1", "account 12", "ACCOUNT 12", "a.b", "ab", "abc", "é12", "x"]
    entities = spark.createDataFrame([(10 + i, n, "Thing", -i) for i, n in enumerate(names)], "id int, name string, entity_type string, position int")
    asked = ["my account 123", "account 1", "acc", "a-b", "AB", "é1", "é12!", "xyabcz", "count 1", None, "nothing"]
    out = facts.resolve_names(spark.createDataFrame([(q,) for q in asked], "subject string"), entities, "subject", "e")
    # contained names are met by their substrings, not by comparing all pairs that share a beginning
    assert "contains" not in out._jdf.queryExecution().optimizedPlan().toString().lower()

    def plain(s):
        return "".join(c for c in s if c in "abcdefghijklmnopqrstuvwxyz0123456789 ").strip()

    def best(q):
        q, hits = q.lower().strip(), []
        for i, n in enumerate(names):
            n = n.lower()
            rank = 1 if n == q else 2 if len(n) >= 3 and len(q) >= 3 and n in q else 3 if len(q) >= 3 and q in n else 4 if len(plain(q)) >= 2 and plain(n) == plain(q) else 0
            hits += [(rank, -i, 10 + i)] * (rank > 0)
        return min(hits)[2] if hits else None

    assert {r["subject"]: r["e"] for r in out.collect()} == {q: q and best(q) for q in asked}


def test_most_similar_matches_all_pairs(spark):
    from collections import Counter
    from random import Random

    from pyspark.sql import functions as F

    from mnemospark.functions.text import trigram_similarity
    from mnemospark.operators import retrieval

    rng = Random(5)
    names = [f"Customer#{i:09d}" for i in [*range(150), *range(5000, 5040)]] + [f"NATION_{i}" for i in range(12)] + ["Customer#000000003"] * 7 + ["", "Acme Works", "Acme Work", "acme", "___"]
    names += ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 60))) for _ in range(120)]
    right = spark.createDataFrame([(f"e{i}", n) for i, n in enumerate(names)], "id string, name string")
    left = spark.createDataFrame([(w,) for w in sorted({*names, "About", "Customer", "Customer#00000500"} - {""})], "word string")
    every = left.crossJoin(right).withColumn("s", F.round(trigram_similarity(F.col("word"), F.col("name")), 6))
    want = {}
    for r in every.where("s > 0.3").collect():
        want.setdefault(r["word"], []).append((-r["s"], r["id"]))
    want = {(w, i) for w, hits in want.items() for _, i in sorted(hits)[:5]}
    got = [tuple(r) for r in retrieval.most_similar(left, right, 0.3, 5).select("word", "id").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # names that are alike in all but their numbers make few candidates
    counts = Counter(r["set_id"] for r in retrieval._near_sets(*[spark.createDataFrame([(i, 18, f"Customer#{i:09d}") for i in range(12345, 12745)], "set_id long, n int, name string")] * 2).select(F.col("a").alias("set_id")).collect())
    assert max(counts.values()) < 40


def test_mentions_broadcast_no_growing_table(spark, monkeypatch):
    import re

    from mnemospark.operators import graph, retrieval

    plans = []

    def kept(df, name, *rest, write=retrieval.staged):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name, *rest)

    monkeypatch.setattr(retrieval, "staged", kept)
    entities = spark.createDataFrame([(f"c:{i}", f"Customer#{i:09d}") for i in range(60)], "id string, name string")
    episodes = entities.selectExpr("concat('About ', name, '.') AS content", "id")
    out = graph.link_mentions(episodes, entities)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    by = {k for p in plans for k in re.findall(r"BroadcastHashJoin \[(\w+)#", p)}
    assert by <= {"g", "m"}  # the trigrams, if few, and the places of groups; files of names are small for their rows
    assert {(r["episode_id"], r["entity_id"]) for r in out.collect()} >= {(f"c:{i}", f"c:{i}") for i in range(60)}
