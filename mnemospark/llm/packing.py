"""Best-fit packing by length patterns.

1. Texts are tokenised and cut into pieces of at most ``size`` tokens.
2. The histogram of piece lengths (at most ``size`` bins, whatever the corpus) goes to
   the driver. Few-document patterns that fill a sequence are enumerated over its bins,
   non-negative least squares fits how often each is repeated, and the counts are
   rounded down. What is left over is packed best-fit decreasing, on the histogram.
3. The plan says, for each length, which ranks go to which sequences and offsets. Pieces
   get their ranks within a length by (length, salt) groups, of which a length has as
   many as its pieces need, so no length, however common, meets in one task.

Defined results: a null or empty text is the end token alone; repeated rows are packed
each; an empty table gives an empty result; a null doc_id stays null. Extra columns are
not read.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

SIZE = 2048
END = 0
SALTS = 64
RANKED = 100_000
CACHE = 400_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Fixed value: how byte-level BPE splits a text.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PROBE = "It's 12 o'clock,  naïve\n\tüber-Ωmega 日本語 \n x..."


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies spell bytes: printable ones stand for
    themselves, the others for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    The vocabulary is that of the tokenizer file. Where its ids are the ranks of its
    merges, as a probe text confirms, tiktoken's faster core runs it. Splitting rules
    start a new unit at a single space that follows a non-space, so the units between
    single spaces encode independently, and a bounded cache keeps those seen before.
    Other texts are encoded whole; those with the string of a special token, and all
    texts if the probe differs, by the tokenizer itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = sorted(added)
        letters = byte_letters()
        ranks = {bytes(letters[x] for x in t): i for t, i in self.tokenizer.get_vocab(False).items() if t not in added and all(x in letters for x in t)}
        core = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.core = core.encode_ordinary if core.encode_ordinary(PROBE) == self.tokenizer.encode(PROBE, add_special_tokens=False).ids else None
        self.cache: dict[str, bytes] = {}

    def slow(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def one(self, text: str) -> bytes:
        if not text:
            return b""
        if self.core is None or any(x in text for x in self.special):
            return self.slow(text)
        if "  " in text or text[0] == " " or text[-1] == " ":
            return array("I", self.core(text)).tobytes()
        cache, core = self.cache, self.core
        first, *rest = text.split(" ")
        out = [array("I", core(first)).tobytes()]
        for unit in rest:
            ids = cache.get(unit)
            if ids is None:
                ids = array("I", core(" " + unit)).tobytes()
                if len(unit) < 32:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[unit] = ids
            out.append(ids)
        return b"".join(out)

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [self.one(t) for t in texts]


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than size."""
    first = n % size or size
    return [(0, min(n, first))] + [(s, size) for s in range(first, n, size)]


def tokenize(docs: DataFrame, path: str, size: int = SIZE, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece; ``with_ids`` adds ids array<long>."""
    tail = np.array([end], dtype="<u4").tobytes()
    schema = PIECES + (", ids array<long>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cols: list[list] = [[] for _ in range(5 + with_ids)]
                for doc_id, ids in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids += tail
                    for k, (s, n) in enumerate(cut(len(ids) // 4, size)):
                        own = ids[4 * s : 4 * (s + n)]
                        for c, v in zip(cols, (doc_id, k, s, n, zlib.crc32(own)), strict=False):
                            c.append(v)
                        if with_ids:
                            cols[5].append(np.frombuffer(own, "<u4").astype("i8"))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=False)], names[: len(cols)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def patterns(lengths: np.ndarray, size: int, gap: int = 2, most: int = 20_000) -> list[tuple[int, ...]]:
    """Multisets of two to four lengths that leave at most ``gap`` tokens of a sequence free.

    ``most`` bounds the columns of the fit, not the pieces: what no pattern takes up is
    packed as a residual.
    """
    present = np.zeros(size + 1, bool)
    present[lengths] = True
    below = np.zeros(size + 1, int)  # largest present length up to each
    for x in range(1, size + 1):
        below[x] = x if present[x] else below[x - 1]
    out: dict[tuple[int, ...], int] = {}

    def add(*head: int) -> None:
        room = size - sum(head)
        if room > 0 and (last := int(below[min(room, head[-1])])) and room - last <= gap:
            out.setdefault((*head, last), room - last)

    some = lengths[:: max(1, len(lengths) // 90)]
    few = lengths[:: max(1, len(lengths) // 24)]
    for a in lengths.tolist():
        add(a)
        for b in some.tolist():
            if b <= a:
                add(a, b)
    for a in some.tolist():
        for b in few.tolist():
            for c in few.tolist():
                if c <= b <= a:
                    add(a, b, c)
    return sorted(out, key=lambda p: (len(p), out[p], p))[:most]


def nnls(columns: list[tuple[int, ...]], counts: np.ndarray, steps: int = 200) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |Ax - counts|^2 by accelerated projected gradient.

    A has a column for each pattern, with how many pieces of each length it takes.
    """
    slot = np.concatenate([np.array(p) for p in columns])
    col = np.repeat(np.arange(len(columns)), [len(p) for p in columns])
    times = lambda x: np.bincount(slot, x[col], len(counts))
    back = lambda r: np.bincount(col, r[slot], len(columns))
    norm = np.ones(len(columns))
    for _ in range(20):
        norm = back(times(norm))
        top = np.linalg.norm(norm)
        norm /= top
    x = y = np.zeros(len(columns))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(times(y) - counts) / (1.05 * top))
        t, was = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y, x = new + (was - 1) / t * (new - x), new
    return x


def plan(histogram: dict[int, int], size: int = SIZE) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, pieces, first sequence, offset), and the number of sequences.

    A run places ``pieces`` pieces of one length, in rank order, at one offset of
    consecutive sequences.
    """
    left = np.zeros(size + 1, dtype=np.int64)
    for n, c in histogram.items():
        left[n] = c
    rank = np.zeros(size + 1, dtype=np.int64)
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def place(pattern: tuple[int, ...], times: int) -> None:
        nonlocal sequences
        offset = 0
        for n in pattern:
            runs.append((n, int(rank[n]), times, sequences, offset))
            rank[n] += times
            left[n] -= times
            offset += n
        sequences += times

    if left[size]:
        place((size,), int(left[size]))
    lengths = np.flatnonzero(left)
    if len(lengths) and (columns := patterns(lengths, size)):
        fitted = np.floor(nnls(columns, left.astype(float)) + 1e-6).astype(np.int64)
        for k in np.argsort(-fitted, kind="stable"):
            need: dict[int, int] = {}
            for n in columns[k]:
                need[n] = need.get(n, 0) + 1
            times = min([int(fitted[k]), *(int(left[n]) // c for n, c in need.items())])
            if times > 0:
                place(columns[k], times)
    while (lengths := np.flatnonzero(left)).size:  # best fit decreasing, equal sequences at once
        room, pattern, used = size, [], np.zeros(size + 1, dtype=np.int64)
        while room and (fit := lengths[(lengths <= room) & (left[lengths] > used[lengths])]).size:
            n = int(fit[-1])
            pattern.append(n)
            used[n] += 1
            room -= n
        taken = np.flatnonzero(used)
        place(tuple(pattern), int((left[taken] // used[taken]).min()))
    return runs, sequences


def salts_of(counts: dict[int, int], size: int) -> np.ndarray:
    """Groups that each length is ranked in: SALTS or more, so that none exceeds RANKED pieces by much."""
    out = np.ones(size + 1, dtype=np.int64)
    for n, c in counts.items():
        out[n] = max(1, min(c // 16, max(SALTS, -(-c // RANKED))))
    return out


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Add sequence_id and offset to staged ``pieces`` (any rows with a length of 1 to size)."""
    spark = pieces.sparkSession
    histogram = dict(pieces.groupBy("length").count().collect())  # size rows at most
    salts = salts_of(histogram, size)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.element_at(F.lit(salts), F.col("length").cast("int") + 1)).cast("int"))
    counts = salted.groupBy("length", "salt").count().collect()  # a row for each group
    first = np.concatenate(([0], np.cumsum(salts)))  # place of a length's groups in ``base``
    base = np.zeros(first[-1], dtype=np.int64)
    before: dict[int, int] = {}
    for r in sorted(counts, key=lambda r: (r["length"], r["salt"])):
        base[first[r["length"]] + r["salt"]] = before.get(r["length"], 0)
        before[r["length"]] = before.get(r["length"], 0) + r["count"]
    runs, _ = plan(before, size)
    by_length: dict[int, list[tuple[int, int, int, int]]] = {}
    for n, start, times, sequence, offset in runs:
        by_length.setdefault(n, []).append((start, times, sequence, offset))
    starts = {n: np.array([r[0] for r in sorted(rs)]) for n, rs in by_length.items()}
    places = {n: np.array(sorted(rs), dtype=np.int64) for n, rs in by_length.items()}
    shared = spark.sparkContext.broadcast((starts, places, first, base))  # bounded by size, the patterns and a number for each RANKED pieces
    return _ranked(salted).mapInArrow(_placer(shared, [c for c in pieces.columns]), pieces.selectExpr("*", "cast(0 as bigint) sequence_id", "cast(0 as bigint) offset").schema)


def _ranked(salted: DataFrame) -> DataFrame:
    """Rank of each piece within its length and salt."""
    from pyspark.sql import Window

    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    return salted.withColumn("rank", F.row_number().over(order) - 1)


def _placer(shared, columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, places, first, base = shared.value
        for batch in batches:
            length, salt, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "salt", "rank"))
            rank = rank + base[first[length] + salt]
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                mine = np.flatnonzero(length == n)
                at = places[n][np.searchsorted(starts[n], rank[mine], side="right") - 1]
                sequence[mine] = at[:, 2] + rank[mine] - at[:, 0]
                offset[mine] = at[:, 3]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, path: str, size: int = SIZE, end: int = END, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack: a row for each piece, with its sequence and offset."""
    return pack(staged(tokenize(docs, path, size, end, with_ids), "pieces", batch_rows=1000), size)
