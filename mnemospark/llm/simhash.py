"""SimHash near-duplicates through pivot distance tables.

Fingerprints are 64-bit SimHashes of word shingles. Two link when they differ in at most
``radius`` bits; components are the transitive closure.

Pivots are fixed reference fingerprints. They stand in four families, one for each
16-bit segment; the pivots of a family agree outside its segment, so distances to them,
less the distance to the family's base pivot, depend on that segment alone. For every
distinct fingerprint the table holds the distances to all pivots.

* Candidates: a pair within 2 bits leaves at least two segments untouched, hence all
  relative distances of two families equal. Those vectors of distances are join keys.
* Discard: distances to one pivot differ by no more than the fingerprints do, so a pair
  whose largest coordinate difference, read from the table, exceeds the radius goes
  without verification.
* Verify: the Hamming distance of the rest.

A key shared by more than ``dense`` fingerprints would need all pairs of its group.
Its members take an exact other way: two fingerprints are within 2 bits if and only if
some fingerprint is within 1 bit of both, so members are grouped by the 65 fingerprints
about each, and everything in such a ball is linked to its smallest member. That is
linear, and with the pairs of the other keys it finds every link.

Copies share a fingerprint, and only distinct fingerprints are compared.

Defined results: a null, empty or blank text has fingerprint zero, linked like any
other; rows with a null doc_id belong to groups but never name them; repeated rows share
a group; an empty table gives an empty result. Extra columns are kept by :func:`dedup`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import heavy_join, staged
from .components import components

BITS = 64
SEGMENTS = 4
WIDTH = BITS // SEGMENTS
PIVOTS = 20  # of each family, beside its base
SEED = 42
BLOCK = 1 << 16


def pivots() -> list[list[int]]:
    """Families of pivots: the base, then PIVOTS fingerprints that differ from it in one segment."""
    rng = np.random.default_rng(SEED)
    base = int(rng.integers(0, 1 << 63)) * 2 + 1
    out = []
    for s in range(SEGMENTS):
        seen: set[int] = set()
        while len(seen) < PIVOTS:
            seen.add(int(rng.integers(1, 1 << WIDTH)))
        out.append([base, *(base ^ (x << (s * WIDTH)) for x in sorted(seen))])
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of a text's word shingles, unsigned."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    count = np.zeros(BITS, dtype=np.int64)
    total = max(1, len(words) - shingle + 1)
    for at in range(0, total, BLOCK):  # long texts in blocks
        part = words[at : at + BLOCK + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
        h = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), dtype=np.uint64)
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << i for i in range(BITS) if 2 * count[i] > total))


def fingerprints(docs: DataFrame, keep: list[str], shingle: int = 3) -> DataFrame:
    """``keep`` columns and fp, the fingerprint as a signed long."""
    rows = docs.select(*keep, F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [signed(fingerprint(t.as_py(), shingle)) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp, pa.int64())], [*batch.schema.names[:-1], "fp"])

    return rows.mapInArrow(run, rows.drop("__text").schema.add("fp", "long"))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def pivot_table(fps: DataFrame) -> DataFrame:
    """fp and a column d<s> for each family: distances to its pivots, base first, as bytes."""
    out = [F.col("fp")]
    for s, family in enumerate(pivots()):
        out.append(F.array(*[distance(F.col("fp"), F.lit(signed(p))).cast("byte") for p in family]).alias(f"d{s}"))
    return fps.select(*out)


def _relative(s: int) -> Column:
    d = F.col(f"d{s}")
    return F.transform(F.slice(d, 2, PIVOTS), lambda x: x - F.element_at(d, 1))


def links(fps: DataFrame, radius: int = 2, dense: int = 64) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose closure equals that of all links."""
    if not 0 <= radius <= 2:
        raise ValueError("two segments stay untouched for a radius of 2 at most")
    table = staged(pivot_table(fps), "pivots")
    keys = [F.xxhash64(F.lit(s * SEGMENTS + t), _relative(s), _relative(t)) for s in range(SEGMENTS) for t in range(s + 1, SEGMENTS)]
    keyed = table.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = staged(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "keys")
    by_key = staged(keyed.join(sizes, "key"), "keyed")
    few = by_key.where(F.col("n") <= dense)
    left, right = few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    pairs = left.join(right, "key").where("a < b").select("a", "b").distinct()
    coordinates = table.select("fp", F.concat(*[f"d{s}" for s in range(SEGMENTS)]).alias("at"))
    placed = pairs.join(coordinates.toDF("a", "x"), "a").join(coordinates.toDF("b", "y"), "b")
    apart = F.array_max(F.zip_with("x", "y", lambda x, y: F.abs(x.cast("int") - y.cast("int"))))
    near = placed.where(apart <= radius).where(distance(F.col("a"), F.col("b")) <= radius).select("a", "b")
    crowd = by_key.where(F.col("n") > dense).select("fp").distinct()
    return near.union(_balls(crowd, radius))


def _balls(fps: DataFrame, radius: int) -> DataFrame:
    """Edges from the members of each 1-bit ball to the smallest, for fingerprints of crowded keys."""
    if radius < 2:
        flips = [signed(1 << i) for i in range(BITS)]
        other = fps.select(F.col("fp").alias("b"))
        near = fps.select(F.col("fp").alias("a"), F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(x)) for x in flips])).alias("b"))
        return near.join(other, "b").select("a", "b") if radius else fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    flips = [0, *(signed(1 << i) for i in range(BITS))]
    around = fps.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(x)) for x in flips])).alias("ball"))
    members = around.groupBy("ball").agg(F.collect_list("fp").alias("fps"), F.min("fp").alias("a"))  # 65 at most
    return members.where(F.size("fps") > 1).select("a", F.explode("fps").alias("b")).where("a != b").distinct()


def groups(docs: DataFrame, keep: list[str], radius: int = 2, dense: int = 64, shingle: int = 3) -> DataFrame:
    """``keep`` columns, fp and root: the smallest fingerprint of the component."""
    rows = staged(fingerprints(docs, keep, shingle), "fingerprints")
    distinct = staged(rows.select("fp").distinct(), "distinct")
    found = components(links(distinct, radius, dense))
    return heavy_join(rows, found.withColumnRenamed("node", "fp"), "fp").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, radius: int = 2, dense: int = 64, shingle: int = 3) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id of the component, for every row."""
    rows = staged(groups(docs, ["doc_id"], radius, dense, shingle), "groups")
    first = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return heavy_join(rows, first, "root").select("doc_id", "fp", "component_id")


def dedup(docs: DataFrame, radius: int = 2, dense: int = 64, shingle: int = 3) -> DataFrame:
    """One row of each component: that with the smallest doc_id (nulls last)."""
    keyed = docs.withColumn("__k", row_key())
    return first_rows(keyed, groups(keyed, ["doc_id", "__k"], radius, dense, shingle))


def row_key() -> Column:
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.coalesce(F.col("text"), F.lit("")))


def first_rows(keyed: DataFrame, rows: DataFrame) -> DataFrame:
    """The first row of ``keyed`` in each group of ``rows`` (doc_id, __k, root)."""
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "__k")).alias("k")).select(F.col("k.__k").alias("__k"))
    kept = keyed.join(best, "__k", "left_semi")
    one = Window.partitionBy("__k").orderBy(F.lit(1))  # repeated rows share a key
    return kept.withColumn("__n", F.row_number().over(one)).where("__n = 1").drop("__n", "__k")
