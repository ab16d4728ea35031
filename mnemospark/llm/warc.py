"""WARC archives: a writer with revisit records, and a reader that salvages damage.

Writing: equal payloads of ``min_bytes`` or more are stored once, in the response record
of the largest page_id; the other pages get revisit records that refer to it. Records are
whole strings, written by Spark's own committed text writer, so a lost executor leaves no
half file, and the archives can be in any store that Spark can write.

Reading: archives come through Spark's binary reader, a file at a time. The parser checks
each record: its version line, headers, block within the file, end mark, and payload
length and digest. After a failed check it searches for the next version line or gzip
member that parses, goes on there, and logs the bytes between as a quarantined gap. Of a
damaged gzip member it keeps the records that can be read.

Defined results: a null html is an empty payload; a null url has an empty target; rows
that share a page_id are separate records; an empty table gives an empty result. Extra
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CLEANUP, new_path, staged

VERSION = b"WARC/1."
GZIP = b"\x1f\x8b\x08"
TYPES = {"warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation"}
END = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SALTS = 16
FILTER = 1 << 19
CHUNK = 1 << 16
BATCH_BYTES = 1 << 24
#: Largest record of a class, and the records of a file: 64 MB at most, but for one record that is larger.
CLASSES = ((1 << 17, 500), (1 << 21, 32), (1 << 25, 2), (None, 1))


@dataclass(frozen=True)
class Record:
    start: int
    end: int
    headers: dict[str, str]
    block: bytes


@dataclass(frozen=True)
class Gap:
    """Quarantined bytes [start, end) and why."""

    start: int
    end: int
    reason: str


def digest_header(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _parse(data: bytes, at: int) -> tuple[int, dict[str, str], bytes]:
    """End, headers and block of the plain record at ``at``; ValueError if a check fails."""
    if not data.startswith(VERSION, at):
        raise ValueError("no version line")
    following = data.find(b"\r\n" + VERSION, at)
    head = data.find(END, at, following + 2 if following >= 0 else len(data))  # of any length, but not beyond the next version line
    if head < 0:
        raise ValueError("headers do not end")
    headers: dict[str, str] = {}
    for line in data[at:head].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("bad header line")
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if headers.get("warc-type") not in TYPES or "warc-record-id" not in headers:
        raise ValueError("no record type or id")
    size = headers.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", size):
        raise ValueError("bad content length")
    end = head + 4 + int(size)
    if data[end : end + 4] != END:
        raise ValueError("no end mark after the block")
    block = data[head + 4 : end]
    _checked(headers, block)
    return end + 4, headers, block


def _checked(headers: dict[str, str], block: bytes) -> None:
    """ValueError where the headers are damaged or contradict the payload; that of a revisit is elsewhere."""
    declared, digest = headers.get("payload-length"), sha1_of(headers)
    if declared is not None and not re.fullmatch("[0-9]{1,18}", declared):
        raise ValueError("bad payload length")
    if headers["warc-type"] == "revisit":
        return
    payload = payload_of(headers, block)
    if declared is not None and int(declared) != len(payload):
        raise ValueError("payload length differs")
    if digest is not None and digest != hashlib.sha1(payload).hexdigest():
        raise ValueError("payload digest differs")


def sha1_of(headers: dict[str, str]) -> str | None:
    """The payload digest in hex; None if there is none, or one of another algorithm."""
    name, _, value = headers.get("warc-payload-digest", "").partition(":")
    if name.lower() != "sha1":
        return None
    try:
        raw = bytes.fromhex(value) if len(value) == 40 else base64.b32decode(value)
    except ValueError as e:  # binascii.Error is one
        raise ValueError("bad payload digest") from e
    if len(raw) != 20:
        raise ValueError("bad payload digest")
    return raw.hex()


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """The block, without HTTP headers where it is an HTTP message."""
    if headers.get("content-type", "").startswith("application/http"):
        return block.partition(END)[2]
    return block


def _member(data: bytes, at: int) -> tuple[int | None, bytes, str]:
    """End of the gzip member at ``at``, or None, its plain bytes as far as they can be had, and what stopped them."""
    inflate = zlib.decompressobj(31)
    view, place, plain = memoryview(data), at, []
    try:
        while not inflate.eof and place < len(data):
            plain.append(inflate.decompress(view[place : place + CHUNK]))
            place = min(len(data), place + CHUNK)
    except zlib.error as e:
        return None, b"".join(plain), f"gzip: {e}"
    if not inflate.eof:
        return None, b"".join(plain), "gzip member does not end"
    return place - len(inflate.unused_data), b"".join(plain), ""


def _plain(data: bytes) -> Iterator[Record | Gap]:
    """Records and gaps of plain bytes."""
    at = 0
    lost, reason = None, ""
    while at < len(data):
        try:
            end, headers, block = _parse(data, at)
        except ValueError as e:
            if lost is None:
                lost, reason = at, str(e)
            after = data.find(VERSION, at + 1)
            at = after if after >= 0 else len(data)
            continue
        if lost is not None:
            yield Gap(lost, at, reason)
            lost = None
        yield Record(at, end, headers, block)
        at = end
    if lost is not None:
        yield Gap(lost, len(data), reason)


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """Records and gaps of an archive, in order; together they cover every byte.

    Records of a gzip member have its place. A member that cannot be inflated to its end,
    or that holds a damaged record, gives the records that can be read, and is a gap as well.
    """
    at = 0
    lost, reason = None, ""
    while at < len(data):
        found: list[Record] = []
        end, why = None, ""
        if data.startswith(GZIP, at):
            end, plain, why = _member(data, at)
            for x in _plain(plain):
                if isinstance(x, Gap):
                    why = why or f"in the member, at {x.start}: {x.reason}"
                else:
                    found.append(x)
        else:
            try:
                end, headers, block = _parse(data, at)
                found = [Record(at, end, headers, block)]
            except ValueError as e:
                why = str(e)
        if why and lost is None:
            lost, reason = at, why
        if end is None:
            after = [x for x in (data.find(VERSION, at + 1), data.find(GZIP, at + 1)) if x >= 0]
            end = min(after, default=len(data))
        elif why:  # a whole member, in part damaged
            yield Gap(lost, end, reason)
            lost = None
        elif lost is not None:
            yield Gap(lost, at, reason)
            lost = None
        for x in found:
            yield Record(at, end, x.headers, x.block)
        at = end
    if lost is not None:
        yield Gap(lost, len(data), reason)


def gzip_member(record: bytes) -> bytes:
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(record) + deflate.flush()


def records(pages: DataFrame, min_bytes: int = 1000, also: dict[str, Column] | None = None) -> DataFrame:
    """A ``record`` string for every row of ``pages`` (page_id, url, html), and the columns of ``also``.

    The owner of a payload is found on digests alone, and only payloads that may have
    copies are shuffled. A payload that a third of the rows
    share is salted, so its rows meet their owner in many tasks.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"), F.length(payload).alias("n"), F.sha1(payload).alias("sha1"), *[c.alias(name) for name, c in (also or {}).items()])
    owners = staged(rows.where(F.col("n") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("sha1", "owner"), "owners")
    # payloads that surely have no copy stay where they are
    perhaps = _perhaps(owners)
    single = rows.where(~perhaps).withColumn("owner", F.lit(None).cast(rows.schema["page_id"].dataType))
    spread = owners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # rows that share the largest page_id are all responses
    salted = rows.where(perhaps).withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    joined = single.unionByName(salted.join(spread, ["sha1", "salt"], "left").drop("salt"))
    revisit = F.coalesce(F.col("owner") != F.col("page_id"), F.lit(False)) & (F.col("n") >= min_bytes)
    block = F.when(revisit, "").otherwise(F.col("html"))
    line = "\r\n"
    record = F.concat(
        F.lit(f"WARC/1.1{line}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{line}WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(f">{line}WARC-Date: {DATE}{line}WARC-Target-URI: "),
        F.regexp_replace("url", "[\\r\\n]", "%0A"),
        F.lit(f"{line}WARC-Payload-Digest: sha1:"), _base32(F.col("sha1")),
        F.lit(f"{line}Payload-Length: "), F.col("n").cast("string"),
        F.when(revisit, F.concat(F.lit(f"{line}WARC-Refers-To: <urn:page:"), F.col("owner").cast("string"), F.lit(f">{line}WARC-Profile: {PROFILE}"))).otherwise(""),
        F.lit(f"{line}Content-Type: text/html{line}Content-Length: "), F.length(F.encode(block, "UTF-8")).cast("string"), F.lit(line + line), block,
    )
    return joined.select(record.alias("record"), *(also or {}))


def _perhaps(owners: DataFrame) -> Column:
    """False where ``sha1`` is surely not in ``owners``: a bitmap of FILTER bits, whatever their number.

    A full bitmap only means that more rows take the shuffle.
    """
    bit = F.pmod(F.xxhash64("sha1"), F.lit(FILTER))
    words = owners.select(bit.alias("b")).groupBy(F.shiftright("b", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("bits")).collect()
    if not words:
        return F.lit(False)
    table = np.zeros(FILTER // 64, dtype=np.int64)
    for r in words:
        table[r["w"]] = r["bits"]
    return F.call_function("shiftright", F.element_at(F.lit(table), F.shiftright(bit, 6).cast("int") + 1), F.pmod(bit, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1


def _base32(hexed: Column) -> Column:
    """Base-32 letters of a 40-digit hex string: five digits hold 20 bits, four letters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = []
    for i in range(8):
        value = F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            parts.append(F.substring(F.lit(letters), F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*parts)


def write(pages: DataFrame, path: str, min_bytes: int = 1000) -> None:
    """Write the archives of ``pages`` to the folder ``path``, in files of bounded size.

    Records of like size share files, so that the number of records bounds the bytes; most
    tables have one such class. A record string ends in CR LF CR; the line separator of
    the text writer is the last LF.
    """
    spark = pages.sparkSession
    size = F.coalesce(F.octet_length("html"), F.lit(0)) + F.coalesce(F.octet_length("url"), F.lit(0))
    largest = [F.lit(most) for most, _ in CLASSES[:-1]]
    number = F.lit(0)
    for most in largest:
        number = number + F.when(size > most, 1).otherwise(0)
    present = sorted(r[0] for r in pages.select(number.alias("c")).distinct().collect()) or [0]
    lines = records(pages, min_bytes, {"__class": number}).select(F.concat("record", F.lit("\r\n\r")).alias("value"), "__class")
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        for c in present:
            own = lines.where(F.col("__class") == c).select("value") if len(present) > 1 else lines.select("value")
            own.write.mode("append").option("lineSep", "\n").option("maxRecordsPerFile", CLASSES[c][1]).text(path)
    finally:
        spark.conf.set(CLEANUP, before)


RECORDS = "file string, start long, end long, kind string, page_id long, url string, refers_to long, declared_length long, payload binary, payload_sha1 string, digest string, reason string"


def _page(urn: str) -> int | None:
    body = urn.removeprefix("<urn:page:").removesuffix(">")
    number = int(body) if re.fullmatch("-?[0-9]{1,19}", body) else None
    return number if number is not None and -(2**63) <= number < 2**63 else None


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record, and one of kind ``gap`` for each quarantined stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("refers_to", pa.int64()), ("declared_length", pa.int64()), ("payload", pa.binary()), ("payload_sha1", pa.string()), ("digest", pa.string()), ("reason", pa.string())])
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows: list[tuple] = []
                held = 0
                for r in salvage(content.as_py()):
                    if isinstance(r, Gap):
                        rows.append((name.as_py(), r.start, r.end, "gap", None, None, None, None, None, None, None, r.reason))
                    else:
                        h, payload = r.headers, payload_of(r.headers, r.block)
                        refers = h.get("warc-refers-to")
                        rows.append((name.as_py(), r.start, r.end, h.get("warc-type"), _page(h.get("warc-record-id", "")), h.get("warc-target-uri"), _page(refers) if refers else None, int(h.get("payload-length", len(payload))), payload, hashlib.sha1(payload).hexdigest(), sha1_of(h), None))
                        held += len(payload)
                    if len(rows) >= 200 or held > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content")
    return files.mapInArrow(run, RECORDS)


def archive_round_trip(pages: DataFrame, min_bytes: int = 1000, path: str | None = None) -> DataFrame:
    """Write the archives, and read them back."""
    path = path or new_path(pages.sparkSession, "warc")
    write(pages, path, min_bytes)
    return read(pages.sparkSession, path)
