"""Distributed union-find: connected components of an edge table, by DataFrame joins alone.

The algorithm alternates large-star and small-star steps, each of which turns the
neighbours of a node towards the smallest of them. The edges shrink to stars about the
smallest node of each component. Every round is written to the shared folder, so its
lineage is one scan long, and nothing but two sums comes to the driver. At most ``FEW``
edges, which are some MB, are joined on the driver instead, as rounds of many small tasks
take longer than the work in them; the result is the same.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import staged, unstage

#: Edges of long ids that the driver joins by itself.
FEW = 1 << 18


def _joined(edges: DataFrame) -> DataFrame:
    """(node, root) of few edges (u, v) of longs: labels fall to the least of a neighbour's, and labels of labels are followed."""
    pairs = edges.toArrow()
    ends = np.stack([pairs.column("u").to_numpy(), pairs.column("v").to_numpy()])
    nodes, at = np.unique(ends, return_inverse=True)
    u, v = at.reshape(ends.shape)
    label = np.arange(len(nodes))
    while len(u) and (label[u] != label[v]).any():
        a, b = label[u], label[v]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    return edges.sparkSession.createDataFrame(pd.DataFrame({"node": nodes, "root": nodes[label]}), "node long, root long")


def _star(edges: DataFrame) -> DataFrame:
    """From (u, v): every v, and u itself, linked to the smallest of u and its v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Edges run from larger u to smaller v."""
    linked = _star(edges)
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(linked.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node reachable.

    Loops, repeated and reversed edges are allowed; rows with a null end are ignored.
    """
    now = staged(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if isinstance(now.schema["u"].dataType, LongType) and now.limit(FEW + 1).count() <= FEW:
        return staged(_joined(now), "joined")
    before = None
    while True:
        then, now = now, staged(_small(_large(now)), "edges")
        unstage(then)
        # stars about the roots: no node is both an end and a root, and the step changed nothing
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct().toDF("node", "root"))
