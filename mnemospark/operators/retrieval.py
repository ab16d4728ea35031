"""Retrieval: vector and lexical top-k, reciprocal rank fusion, reranking, context text.

All legs are branches of one plan. Top-k is a sort with a limit, which keeps k rows of
each partition; scores of ties are ordered by id.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.temporal import effective_at, validity_suffix
from ..functions.text import jaccard, tokens, trigram_similarity, trigrams
from ..functions.vector import cosine_score
from ..sources.staging import if_small, staged

RRF_K = 60
K1, B = 1.2, 0.75
SEPARATOR = "-" * 40
MAX_CONTENT = 2000


def vector_topk(df: DataFrame, query: list[float] | Column, k: int, vector: str = "embedding", as_of: Column | None = None) -> DataFrame:
    """The k rows nearest by cosine; rows with no vector, or one of another size, are out."""
    q = query if isinstance(query, Column) else F.lit([float(x) for x in query])
    rows = df if as_of is None else df.where(effective_at(as_of))
    scored = rows.where(F.col(vector).isNotNull() & (F.size(vector) == F.size(q))).withColumn("score", F.round(cosine_score(F.col(vector), q), 9))
    return scored.orderBy(F.desc("score"), "id").limit(k)


def lexical_topk(df: DataFrame, query: str, k: int, text: str = "content", as_of: Column | None = None) -> DataFrame:
    """The k rows of highest BM25 that contain all terms of the query.

    Texts are tokenised once, into a narrow table of lengths and term counts. Its exchange
    serves both the statistics, over all rows, and the scores; of the rows themselves only
    the k hits are read. ``id`` names a row.
    """
    spark = df.sparkSession
    terms = sorted(set(spark.range(1).select(tokens(F.lit(query))).first()[0]))
    rows = df if as_of is None else df.where(effective_at(as_of))
    if not terms:
        return rows.withColumn("score", F.lit(0.0)).limit(0)
    t = F.col("__t")
    counted = rows.select("id", tokens(F.col(text)).alias("__t")).select("id", F.size(t).alias("__len"), *[F.size(F.filter(t, _equals(x))).alias(f"__f{i}") for i, x in enumerate(terms)])
    counted = counted.repartition("id")
    stats = counted.agg(F.count(F.lit(1)).cast("double").alias("__n"), F.avg("__len").alias("__avg"), *[F.count_if(F.col(f"__f{i}") > 0).alias(f"__d{i}") for i in range(len(terms))])
    match = F.lit(True)
    score = F.lit(0.0)
    for i in range(len(terms)):
        f, d = F.col(f"__f{i}"), F.col(f"__d{i}")
        match = match & (f > 0)
        idf = F.log(1 + (F.col("__n") - d + 0.5) / (d + 0.5))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("__len") / F.col("__avg")))
    hits = counted.where(match).crossJoin(F.broadcast(stats))  # one row of statistics
    best = hits.select("id", F.round(score, 9).alias("score")).orderBy(F.desc("score"), "id").limit(k)
    return rows.join(F.broadcast(best), "id").select(*rows.columns, "score").orderBy(F.desc("score"), "id").limit(k)


def _equals(term: str) -> Callable[[Column], Column]:
    return lambda x: x == term


def ranked(df: DataFrame, list_no: int) -> DataFrame:
    """Rank of a result list, from 1."""
    return df.withColumn("list_no", F.lit(list_no)).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def rrf(lists: list[DataFrame], top_n: int, k: int = RRF_K) -> DataFrame:
    """Fuse ranked lists (list_no, rank, id, ...): each id scores the sum of 1 / (k + rank).

    The row of an id's first list stays; ties keep the order of first appearance.
    """
    union = lists[0]
    for other in lists[1:]:
        union = union.unionByName(other, allowMissingColumns=True)
    payload = [c for c in union.columns if c not in ("id", "list_no", "rank")]
    first = F.min_by(F.struct(*payload), F.struct("list_no", "rank")) if payload else F.lit(None)
    fused = union.groupBy("id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 6).alias("rrf_score"), F.min(F.struct("list_no", "rank")).alias("__first"), first.alias("__p"))
    out = fused.orderBy(F.desc("rrf_score"), "__first.list_no", "__first.rank", "id").limit(top_n)
    return out.select("id", "rrf_score", F.col("__first.list_no").alias("list_no"), F.col("__first.rank").alias("rank"), *[F.col(f"__p.{c}").alias(c) for c in payload])


def overlap_scorer(query: str) -> Callable[[Column], Column]:
    """Deterministic stand-in for a cross-encoder: share of terms in common."""
    return lambda content: jaccard(tokens(F.lit(query)), tokens(content))


def rerank(candidates: DataFrame, scorer: Callable[[Column], Column], top_n: int = 10, text: str = "content") -> DataFrame:
    """Order by the scorer; empty content scores 0. Positions of all candidates count."""
    content = F.coalesce(F.col(text), F.lit(""))
    return candidates.withColumn("reranker_score", F.round(F.when(F.trim(content) == "", 0.0).otherwise(scorer(content)), 6)).orderBy(F.desc("reranker_score"), "id").limit(top_n)


def hybrid_search(episodes: DataFrame, facts: DataFrame, query: str, vector: list[float], limit: int, as_of: Column, scorer: Callable[[Column], Column] | None = None, top_k: int = 50) -> dict[str, DataFrame]:
    """Vector and lexical legs of episodes and facts, fused per kind; facts as of an instant."""
    n = max(limit, top_k) if scorer else limit
    out = {}
    for kind, df, t in (("episodes", episodes, None), ("facts", facts, as_of)):
        legs = [ranked(vector_topk(df, vector, n, as_of=t), 1), ranked(lexical_topk(df, query, n, as_of=t), 2)]
        fused = rrf(legs, n)
        out[kind] = rerank(fused, scorer, limit) if scorer else fused.limit(limit)
    return out


def search_entities(entities: DataFrame, query: str, types: list[str] | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """0.6 x trigram similarity of the name + 0.4 x lexical score of the summary, for all that match either."""
    terms = tokens(F.lit(query))
    similarity = trigram_similarity(F.col("name"), F.lit(query))
    summary = F.coalesce(F.col("summary"), F.lit(""))
    share = F.when(F.size(terms) > 0, F.size(F.array_intersect(tokens(summary), terms)) / F.size(terms)).otherwise(0.0)
    rows = entities if types is None else entities.where(F.col("entity_type").isin(types))
    match = F.contains(F.lower("name"), F.lit(query.lower())) | (F.col("__sim") > 0.2) | (F.col("__fts") >= 1)
    scored = rows.withColumn("__sim", similarity).withColumn("__fts", share).where(match)
    return scored.withColumn("score", F.round(0.6 * F.col("__sim") + 0.4 * F.when(F.col("__fts") >= 1, 1.0).otherwise(0.0), 6)).drop("__sim", "__fts").orderBy(F.desc("score"), "id").offset(offset).limit(limit)


def fuzzy_entities(entities: DataFrame, query: str, threshold: float = 0.3, limit: int = 50) -> DataFrame:
    scored = entities.withColumn("similarity", F.round(trigram_similarity(F.col("name"), F.lit(query)), 6))
    return scored.where(F.col("similarity") > threshold).orderBy(F.desc("similarity"), "id").limit(limit)


def _apart(df: DataFrame) -> DataFrame:
    """A table that grows with the names, in a join by a shuffle.

    Names, and arrays of few distinct values, shrink a lot in files. Spark takes the size of the
    files for that of the rows, also of rows exploded from them, and would broadcast millions.
    """
    return df.hint("merge")


def _frequency(grams: DataFrame) -> DataFrame:
    """(g, df) of rows with a trigram g. Names of one form share trigrams, so the common ones are kept from a shuffle as long as all are few."""
    return if_small(staged(grams.groupBy("g").agg(F.count(F.lit(1)).alias("df")), "frequency"), FEW_GRAMS)


def _prefixes(grams: DataFrame, frequency: DataFrame, threshold: float) -> DataFrame:
    """(id, n, g): the rarest trigrams of each name, one of which it shares with every name above the threshold."""
    rare = _apart(grams).join(frequency, "g").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("gs"))
    size = F.size("gs")
    return rare.select("id", size.alias("n"), F.explode(F.slice("gs", F.lit(1), size - F.ceil(size * threshold).cast("int") + 1)).alias("x")).select("id", "n", F.col("x.g").alias("g"))


def _verified(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    named = _apart(_apart(pairs).join(left.select(F.col("id").alias("a"), F.col("name").alias("na")), "a")).join(right.select(F.col("id").alias("b"), F.col("name").alias("nb")), "b")
    return named.withColumn("similarity", F.round(trigram_similarity(F.col("na"), F.col("nb")), 6)).where(F.col("similarity") > threshold).select("a", "b", "similarity")


def similar_pairs(names: DataFrame, threshold: float) -> DataFrame:
    """Pairs a < b of (id, name) with a trigram similarity above ``threshold``.

    Prefix filtering: with trigrams in the order of their frequency, two names above the
    threshold share one of their rarest. Only those are join keys, so common trigrams
    make no pairs.
    """
    grams = names.select("id", F.explode(trigrams(F.col("name"))).alias("g"))
    prefix = _prefixes(grams, _frequency(grams), threshold)
    a, b = _apart(prefix).alias("a"), prefix.alias("b")
    long = F.least(F.col("a.n"), F.col("b.n")) >= threshold * F.greatest(F.col("a.n"), F.col("b.n"))
    pairs = a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.id") < F.col("b.id")) & long).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    return _verified(pairs, names, names, threshold)


def similar_between(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, similarity) of two tables (id, name) above ``threshold``, by the same filter."""
    one, two = (df.select("id", F.explode(trigrams(F.col("name"))).alias("g")) for df in (left, right))
    frequency = _frequency(one.select("g").union(two.select("g")))
    a, b = _apart(_prefixes(one, frequency, threshold)).alias("a"), _prefixes(two, frequency, threshold).alias("b")
    long = F.least(F.col("a.n"), F.col("b.n")) >= threshold * F.greatest(F.col("a.n"), F.col("b.n"))
    pairs = a.join(b, (F.col("a.g") == F.col("b.g")) & long).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    return _verified(pairs, left, right, threshold)


#: Names of a similarity of 7/9 meet first, by groups of up to 4 trigrams, of which a name has GROUPS for each size at most.
NEAR = 7 / 9
GROUPS = 70

#: Trigrams of any names in one alphabet are fewer, and take some 20 MB at most when broadcast.
FEW_GRAMS = 1 << 17


def _gram_sets(names: DataFrame) -> DataFrame:
    """(set_id, n, name) for every distinct trigram set of (name, set_id)."""
    return names.groupBy("set_id").agg(F.min("name").alias("name")).withColumn("n", F.size(trigrams(F.col("name")))).where("n > 0")


def _group_keys(sets: DataFrame, rare: DataFrame, others: DataFrame) -> DataFrame:
    """(key, set_id): two sets of a similarity of NEAR share a key.

    Sets of n and k trigrams have c = ceil(7 (n + k) / 16) of them in common at least, so
    of their n - c + m and k - c + m rarest they share m. A key is the sizes and m trigrams.
    """
    n, k = F.col("n"), F.col("k")
    sized = sets.select("set_id", "n").crossJoin(F.broadcast(others.agg(F.collect_set("n").alias("ks")))).select("set_id", "n", F.explode("ks").alias("k"))
    sized = sized.where(9 * F.least(n, k) >= 7 * F.greatest(n, k)).withColumn("c", F.expr("(7 * (n + k) + 15) div 16").cast("int")).where(F.col("c") <= F.least(n, k))
    missed = F.greatest(n, k) - F.col("c")
    most = F.lit(1)
    for m in (2, 3, 4):
        fits = max(x for x in range(GROUPS) if comb(x + m, m) <= GROUPS)
        most = F.when(missed <= fits, m).otherwise(most)
    sized = sized.withColumn("m", F.least(most, F.col("c"))).withColumn("p", n - F.col("c") + F.col("m")).join(_apart(rare), "set_id")
    cut = sized.select("set_id", F.array(F.least(n, k), F.greatest(n, k)).alias("sizes"), "m", "p", F.slice("gs", F.lit(1), F.col("p")).alias("gs"))
    single = cut.where("m = 1").select("set_id", "sizes", F.explode(F.transform("gs", lambda g: F.array(g))).alias("group"))
    places = [(m, p, list(x)) for m in (2, 3, 4) for p in range(m, GROUPS) if comb(p, m) <= GROUPS for x in combinations(range(p), m)]
    picks = sets.sparkSession.createDataFrame(places, "m int, p int, at array<int>")
    several = cut.where("m > 1").join(F.broadcast(picks), ["m", "p"]).select("set_id", "sizes", F.transform("at", lambda i: F.get("gs", i)).alias("group"))
    return single.union(several).select(F.xxhash64("sizes", "group").alias("key"), "set_id")


def _near_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs (a, b, similarity) of two tables of trigram sets (set_id, n, name) with a similarity of NEAR or more."""
    one, two = (df.select("set_id", F.explode(trigrams(F.col("name"))).alias("g")).withColumn("g", F.xxhash64("g")) for df in (left, right))
    frequency = _frequency(one.union(two))
    rare = lambda grams: _apart(grams).join(frequency, "g").groupBy("set_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "g"))), lambda x: x["g"]).alias("gs"))
    gs, hs = staged(rare(one), "left"), staged(rare(two), "right")
    pairs = _apart(_group_keys(left, gs, right).toDF("key", "a")).join(_group_keys(right, hs, left).toDF("key", "b"), "key").select("a", "b").distinct()
    pairs = staged(pairs, "pairs")
    both = _apart(_apart(pairs).join(gs.toDF("a", "ga"), "a")).join(hs.toDF("b", "gb"), "b")
    counted = staged(both.select("a", "b", F.size(F.array_intersect("ga", "gb")).alias("common"), (F.size("ga") + F.size("gb")).alias("sizes")), "counted")
    near = counted.withColumn("all", F.col("sizes") - F.col("common"))
    return near.where(9 * F.col("common") >= 7 * F.col("all")).select("a", "b", F.round(F.col("common") / F.col("all"), 6).alias("similarity"))


def most_similar(words: DataFrame, names: DataFrame, threshold: float, k: int) -> DataFrame:
    """(word, id): for each of the distinct ``words`` the ``k`` names (id, name) most similar above ``threshold``, ties by id.

    Names of one trigram set are equally similar to everything, so sets meet, and a set
    goes on with its first k ids. Words that have k names at NEAR or more are done with
    pairs of such similarity; only the others meet names down to the threshold.
    """
    set_id = F.xxhash64(F.array_sort(trigrams(F.col("name")))).alias("set_id")
    asked = words.select("word", F.col("word").alias("name")).withColumn("set_id", set_id)
    named = names.select("id", "name").withColumn("set_id", set_id)
    first = Window.partitionBy("set_id").orderBy("id")
    ids = staged(named.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= k).groupBy("set_id").agg(F.sort_array(F.collect_list("id")).alias("ids")), "ids")
    left, right = staged(_gram_sets(asked), "words"), staged(_gram_sets(named), "names")
    held = _apart(ids.select(F.col("set_id").alias("b"), "ids"))
    if threshold < NEAR:
        near = staged(_near_sets(left, right).join(held, "b"), "near")
        done = _apart(staged(near.groupBy("a").agg(F.sum(F.size("ids")).alias("n")).where(F.col("n") >= k).select("a"), "done"))
        near = near.join(done, "a", "left_semi")
        left = left.join(done, left["set_id"] == done["a"], "left_anti")
    wide = similar_between(left.select(F.col("set_id").alias("id"), "name"), right.select(F.col("set_id").alias("id"), "name"), threshold).join(held, "b")
    found = wide.select("a", "similarity", "ids") if threshold >= NEAR else wide.select("a", "similarity", "ids").union(near.select("a", "similarity", "ids"))
    best = Window.partitionBy("a").orderBy(F.desc("similarity"), "id")
    top = found.select("a", "similarity", F.explode("ids").alias("id")).withColumn("__n", F.row_number().over(best)).where(F.col("__n") <= k)
    return asked.select("word", F.col("set_id").alias("a")).join(_apart(top.select("a", "id")), "a").select("word", "id")


def similar_to(episodes: DataFrame, episode_id: object, limit: int = 5) -> DataFrame:
    """Lexical neighbours of an episode; itself is dropped after the limit."""
    content = episodes.where(F.col("id") == episode_id).select("content").first()
    return lexical_topk(episodes, content[0] if content else "", limit).where(F.col("id") != episode_id)


def best_name_match(entities: DataFrame, query: str) -> DataFrame:
    """Of the ten best hits: an equal name, else one that holds the query, else one that it holds."""
    q = query.strip().lower()
    name = F.lower(F.trim("name"))
    rank = F.when(name == q, 0).when(F.contains(name, F.lit(q)), 1).when(F.contains(F.lit(q), name), 2)
    return search_entities(entities, query, limit=10).withColumn("__r", rank).where("__r is not null").orderBy("__r", F.desc("score"), "id").limit(1).drop("__r")


def global_search(legs: dict[str, tuple[DataFrame, str, list[str]]], query: str, limit: int) -> DataFrame:
    """Substring search over several tables: (rows, label, searched columns) by type, a third of the limit each."""
    from .paging import search_text

    per = max(1, limit // 3)
    out = None
    for kind, (df, label, columns) in legs.items():
        hits = search_text(df, columns, query).select(F.lit(kind).alias("type"), F.col("id").cast("string").alias("id"), F.col(label).cast("string").alias("label")).orderBy("label", "id").limit(per)
        out = hits if out is None else out.unionByName(hits)
    return out.orderBy("type", "label", "id").limit(limit)


def context_text(episodes: DataFrame | None = None, facts: DataFrame | None = None, entities: DataFrame | None = None, communities: DataFrame | None = None) -> DataFrame:
    """One row with the numbered text of the sections; each input has a position from 1.

    Inputs are result pages, so their rows meet in one group.
    """

    def score(df: DataFrame) -> Column:
        have = [F.col(c) for c in ("reranker_score", "rrf_score", "score") if c in df.columns]
        s = F.coalesce(*have) if have else F.lit(None).cast("double")
        return F.when(s.isNotNull(), F.format_string(" [score=%.4f]", s.cast("double"))).otherwise("")

    def optional(df: DataFrame, name: str, kind: str = "string") -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast(kind)

    at = F.col("position").cast("string")
    sections = []
    if episodes is not None:
        cut = F.when(F.length("content") > MAX_CONTENT, F.concat(F.substring("content", 1, MAX_CONTENT), F.lit("..."))).otherwise(F.col("content"))
        line = F.concat(F.lit("  "), at, F.lit(". ["), F.coalesce("role", F.lit("unknown")), F.lit("]"), score(episodes), F.lit("\n    "), F.replace(cut, F.lit("\n"), F.lit("\n    ")), F.lit("\n"))
        sections.append(_section(episodes, "Recent Episodes", line))
    if facts is not None:
        confidence = optional(facts, "confidence", "double")
        sure = F.when(confidence.isNotNull(), F.format_string(" (confidence=%.2f)", confidence.cast("double"))).otherwise("")
        line = F.concat(F.lit("  "), at, F.lit(". "), F.col("content"), validity_suffix(optional(facts, "valid_from", "timestamp"), optional(facts, "valid_to", "timestamp")), sure, score(facts))
        sections.append(_section(facts, "Facts", line))
    if entities is not None:
        kind, far, summary = optional(entities, "type"), optional(entities, "distance", "int"), optional(entities, "summary")
        line = F.concat(
            F.lit("  "), at, F.lit(". "), F.coalesce("name", F.lit("unknown")), F.when(F.coalesce(kind, F.lit("")) != "", F.concat(F.lit(" ("), kind, F.lit(")"))).otherwise(""),
            F.when(far.isNotNull(), F.concat(F.lit(" [distance="), far.cast("string"), F.lit("]"))).otherwise(""), F.when(F.coalesce(summary, F.lit("")) != "", F.concat(F.lit(" — "), summary)).otherwise(""),
        )
        sections.append(_section(entities, "Entities", line))
    if communities is not None:
        line = F.concat(F.lit("  "), at, F.lit(". "), F.coalesce(F.col("name"), F.concat(F.lit("Community "), at)), F.lit(": "), F.coalesce("summary", F.lit("")))
        sections.append(_section(communities, "Community Summaries", line))
    if not sections:
        raise ValueError("no section")
    out = sections[0]
    for s in sections[1:]:
        out = out.unionByName(s)
    text = out.agg(F.array_sort(F.collect_list(F.struct("order", "section"))).alias("s")).select(F.trim(F.array_join(F.transform("s", lambda x: x["section"]), "\n")).alias("text"))
    return text.select(F.when(F.coalesce("text", F.lit("")) == "", "No context found.").otherwise(F.rtrim(F.col("text"), F.lit("\n"))).alias("text"))


SECTIONS = ["Recent Episodes", "Facts", "Entities", "Community Summaries"]


def _section(df: DataFrame, title: str, line: Column) -> DataFrame:
    rows = df.select("position", line.alias("line")).agg(F.array_sort(F.collect_list(F.struct("position", "line"))).alias("rows"))
    text = F.concat(F.lit(title + " ("), F.size("rows").cast("string"), F.lit("):\n" + SEPARATOR + "\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n"))
    return rows.where(F.size("rows") > 0).select(F.lit(SECTIONS.index(title)).alias("order"), text.alias("section"))


#: The columns that a JSON context keeps of each kind.
CONTEXT_COLUMNS = {
    "episodes": ["id", "role", "content", "score", "rrf_score", "reranker_score", "created_at", "blobs"],
    "facts": ["id", "content", "confidence", "valid_from", "valid_to", "invalid_at", "score", "rrf_score", "reranker_score"],
    "entities": ["id", "name", "type", "summary", "distance"],
    "communities": ["id", "name", "summary"],
}


def context_json(**kinds: DataFrame) -> DataFrame:
    """One row with a JSON document: an array for each kind, in position order, listed columns only."""
    out = None
    for kind, df in kinds.items():
        keep = [c for c in CONTEXT_COLUMNS[kind] if c in df.columns]
        one = df.agg(F.array_sort(F.collect_list(F.struct("position", F.struct(*keep).alias("row")))).alias("r")).select(F.transform("r", lambda x: x["row"]).alias(kind))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out.select(F.to_json(F.struct(*out.columns)).alias("json"))


def with_blobs(results: DataFrame, blobs: DataFrame) -> DataFrame:
    """Attach each episode's blobs, by index."""
    grouped = blobs.groupBy(F.col("episode_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("blob_index", "content_hash", "extracted_text"))).alias("blobs"))
    return results.join(grouped, "id", "left")
