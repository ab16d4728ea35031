"""Exact top-k search of binary codes by incremental multi-index hashing.

Codes are the sign bits of 64-dimensional vectors, cut into m segments of about log2 n - 2
bits for n distinct codes, so a segment value has a few codes, whatever the table's
size. A step looks up, for each query, the index entries whose segment s differs in
exactly r bits. After segments 0 to s at radius r, and all at r - 1, every code within
m r + s bits has been seen: one farther in each would differ in m r + s + 1 bits or more.
A query is done when its k-th distance is covered that way; the others go on with the
next segment or radius, so the result is exact for every query. The k-th distance found
so far bounds what a later step returns.

A code is met in several segments; only the first segment with the least difference
gives the pair, so no pair is made twice. Equal codes are one index entry with its k
smallest ids, and equal queries are searched once, so a vector that many rows share
costs no more than one.

Defined results: vectors that are null, have another length than 64 or hold nulls have
no code: they are neither found nor give results; rows with equal distances come in id
order; repeated ids count as rows; with fewer than k rows a query gets them all; an
empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

BITS = 64
LEAST, MOST = 8, 22  # bits of a segment
WHOLE = 3


def code(vector: Column) -> Column:
    """Sign bits as a signed long; null for vectors without a code."""
    bits = F.transform(vector, lambda x: (x > 0).cast("long"))
    folded = F.aggregate(bits, F.lit(0).cast("long"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b))
    whole = (F.size(vector) == BITS) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    return F.when(whole, folded)


def segments_for(codes: int) -> list[tuple[int, int]]:
    """(shift, width) of the segments for a number of distinct codes."""
    m = round(BITS / min(MOST, max(LEAST, math.log2(max(2, codes)) - 2)))
    ends = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def segment(c: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(c, shift).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def masks(radius: int, width: int = 16) -> list[int]:
    """Segment patterns of exactly ``radius`` bits."""
    return [sum(1 << b for b in bits) for bits in combinations(range(width), radius)]


def steps(cuts: list[tuple[int, int]]) -> list[tuple[int, list[int]]]:
    """(radius, segments) in the order of search: all segments at once while that is cheap, then by halves."""
    every = list(range(len(cuts)))
    half = (len(cuts) + 1) // 2
    return [(r, part) for r in range(max(w for _, w in cuts) + 1) for part in ([every] if r < WHOLE else [every[:half], every[half:]])]


def _first(entries: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return entries.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, distance: the k nearest rows of ``vectors`` for each query row.

    Both tables have (vec_id, embedding). A query that is a row of ``vectors`` finds itself.
    """
    coded = staged(vectors.select("vec_id", code(F.col("embedding")).alias("code")).where("code is not null"), "codes")
    asked = staged(queries.select(F.col("vec_id").alias("query_id"), code(F.col("embedding")).alias("q")).where("q is not null"), "asked")
    entries = staged(_first(coded, ["code"], ["vec_id"], k).groupBy("code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    rows = entries.select(F.explode("ids")).count()
    if not rows:
        return asked.select("query_id", F.lit(1).alias("rank"), F.col("query_id").alias("vec_id"), F.lit(0).alias("distance")).limit(0)
    cuts = segments_for(entries.count())
    index = entries.select("code", "ids", F.posexplode(F.array(*[segment(F.col("code"), *c) for c in cuts])).alias("seg", "value"))
    index = staged(index, "index")
    active = staged(asked.select("q").distinct().withColumn("bound", F.lit(BITS)), "active")
    best, finished = None, None
    apart = [F.bit_count(segment(F.col("q"), *c).bitwiseXOR(segment(F.col("code"), *c))) for c in cuts]
    distance = F.bit_count(F.col("q").bitwiseXOR(F.col("code"))).cast("int")
    for r, segments in steps(cuts):
        own = F.array(*[F.struct(F.lit(s).alias("seg"), segment(F.col("q"), *cuts[s]).alias("own"), F.lit(masks(r, cuts[s][1])).cast("array<int>").alias("masks")) for s in segments])
        probes = active.select("q", "bound", F.explode(own).alias("p")).select("q", "bound", "p.seg", "p.own", F.explode("p.masks").alias("mask"))
        probes = probes.select("q", "bound", "seg", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
        first = distance <= F.col("bound")
        for s in range(len(cuts)):
            first = first & F.when(F.col("seg") > s, apart[s] > r).when(F.col("seg") < s, apart[s] >= r).otherwise(True)
        # the planner takes the probes for as small as the queries they come from: no broadcast
        found = probes.hint("merge").join(index.hint("merge"), ["seg", "value"]).where(first).select("q", distance.alias("distance"), F.explode("ids").alias("vec_id"))
        if best is not None:
            found = found.union(best.join(active, "q", "left_semi").select("q", "distance", "vec_id"))
        top = staged(_first(found, ["q"], ["distance", "vec_id"], k), "top")
        state = top.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"))
        done = state.where(((F.col("n") >= min(k, rows)) & (F.col("far") <= len(cuts) * r + segments[-1])) | (F.col("n") >= rows)).select("q")
        over = staged(top.join(done, "q", "left_semi"), "done")
        finished = over if finished is None else finished.union(over)
        bounds = state.where(F.col("n") >= k).select("q", F.col("far").alias("far"))
        active = staged(active.select("q").join(done, "q", "left_anti").join(bounds, "q", "left").select("q", F.coalesce("far", F.lit(BITS)).alias("bound")), "active")
        best = top
        if active.isEmpty():
            break
    # equal queries share one result; it has k rows a query
    return asked.join(finished, "q").select("query_id", "rank", "vec_id", "distance")
