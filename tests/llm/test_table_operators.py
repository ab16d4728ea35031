"""Brute-force versions and round trips of the operators on pages, vectors and edges."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from mnemospark.llm import topk, url_filter, url_labels, warc
from mnemospark.llm.components import components
from mnemospark.llm.queries import URL_RULES

SAMPLE = "/root/testdata/sf0.001"


# components


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e if x is not None}
    for _ in range(100):
        for a, b in edges:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    linked = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert got == {x: root[x] for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# top-k


def slow_code(v):
    return None if v is None or len(v) != 64 or any(x is None for x in v) else sum(1 << (63 - i) for i, x in enumerate(v) if x > 0)


def check_topk(vectors, queries, k):
    rows = [(r["vec_id"], slow_code(r["embedding"])) for r in vectors.collect()]
    want = []
    for r in queries.collect():
        q = slow_code(r["embedding"])
        if q is not None:
            near = sorted(((q ^ c).bit_count(), i) for i, c in rows if c is not None)[:k]
            want += [(r["vec_id"], n + 1, i, d) for n, (d, i) in enumerate(near)]
    got = [tuple(r) for r in topk.search(vectors, queries, k).select("query_id", "rank", "vec_id", "distance").collect()]
    assert sorted(got) == sorted(want)


def test_topk_matches_brute_force(spark):
    v = spark.read.parquet(f"{SAMPLE}/embeddings.parquet").select("vec_id", "embedding")
    check_topk(v, v.where("vec_id % 50 = 0"), 10)


@pytest.mark.parametrize("codes", [1, 2, 300, 60_000, 10**7, 10**12])
def test_segments(codes):
    cuts = topk.segments_for(codes)
    assert [a for a, _ in cuts] == [sum(w for _, w in cuts[:i]) for i in range(len(cuts))] and sum(w for _, w in cuts) == 64
    assert topk.steps(cuts)[0] == (0, list(range(len(cuts)))) and max(w for _, w in cuts) <= 22


def test_topk_extra_columns(spark):
    v = spark.read.parquet(f"{SAMPLE}/embeddings.parquet")
    for c in ("q", "code", "distance", "rank", "seg", "value", "bound"):
        v = v.withColumn(c, F.lit("x"))
    check_topk(v, v.where("vec_id % 50 = 0"), 3)


def test_topk_ties_copies_and_odd_vectors(spark):
    rng = random.Random(2)
    base = [[rng.choice([-1.0, 1.0]) for _ in range(64)] for _ in range(3)]
    rows = [(i, base[i % 3]) for i in range(40)] + [(100, None), (101, [1.0, 2.0]), (102, [None] * 64), (3, base[0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    check_topk(v, v.where("vec_id % 50 = 0 or vec_id = 101"), 7)
    check_topk(v.limit(2), v.limit(1), 10)  # fewer rows than k
    assert topk.search(v.limit(0), v, 3).count() == 0 and topk.search(v, v.limit(0), 3).count() == 0


# WARC


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 700
    rows = [(1, "http://a/", big), (2, None, big), (3, "http://c/\r\nX: y", "small"), (4, "http://d/", "small"), (5, "http://e/", None), (6, "u", big + "\r\n\r\nWARC/1.1\r\n"), (9, "http://a/", big)]
    df = pages_of(spark, rows).withColumn("record", F.lit("x")).withColumn("salt", F.lit(1))
    got = {r["page_id"]: r for r in warc.archive_round_trip(df, path=f"file://{tmp_path}/w").collect()}
    assert len(got) == 7 and all(r["kind"] != "gap" for r in got.values())
    for page, _, html in rows:
        data = (html or "").encode()
        r = got[page]
        twin = {1: 9, 2: 9}.get(page)
        assert r["kind"] == ("revisit" if twin else "response") and r["refers_to"] == twin
        assert r["declared_length"] == len(data) and r["digest"] == hashlib.sha1(data).hexdigest()
        assert twin or bytes(r["payload"]) == data
    assert warc.archive_round_trip(df.limit(0), path=f"file://{tmp_path}/e").count() == 0


def sample_archive(spark, tmp_path):
    warc.write(pages_of(spark, [(i, f"http://x/{i}", f"page {i} " * 50) for i in range(6)]).coalesce(1), f"file://{tmp_path}/a")
    return b"".join(p.read_bytes() for p in sorted((tmp_path / "a").glob("*.txt")))


def test_salvage_covers_every_byte(spark, tmp_path):
    whole = sample_archive(spark, tmp_path)
    good = list(warc.salvage(whole))
    assert len(good) == 6
    damaged = bytearray(whole)
    damaged[good[2].start + 20 : good[2].start + 40] = b"\x00" * 20  # headers
    damaged[good[4].end - 30] ^= 1  # payload: the digest tells
    cut = bytes(damaged[: len(damaged) - 10])  # and the end is missing
    out = list(warc.salvage(cut))
    assert [type(x).__name__ for x in out] == ["Record", "Record", "Gap", "Record", "Gap"]
    assert out[0].start == 0 and out[-1].end == len(cut) and all(a.end == b.start for a, b in zip(out, out[1:], strict=False))


def test_salvage_gzip_members(spark, tmp_path):
    whole = sample_archive(spark, tmp_path)
    members = [warc.gzip_member(whole[r.start : r.end]) for r in warc.salvage(whole)]
    members[1] = members[1][:30] + b"garbage" + members[1][37:]
    out = list(warc.salvage(b"".join(members) + b"tail"))
    assert sum(isinstance(x, warc.Record) for x in out) == 5
    gaps = [x for x in out if isinstance(x, warc.Gap)]
    assert [(g.start, g.end) for g in gaps] == [(len(members[0]), len(members[0]) + len(members[1])), (sum(map(len, members)), sum(map(len, members)) + 4)]
    assert list(warc.salvage(b"")) == []


def test_warc_long_headers(spark, tmp_path):
    urls = {1: "data:text/html," + "x" * 100_000, 2: "http://a/?q=WARC/1.1&" + "y" * 70_000, 3: "http://b/"}
    got = {r["page_id"]: r for r in warc.archive_round_trip(pages_of(spark, [(i, u, f"page {i}") for i, u in urls.items()]), path=f"file://{tmp_path}/w").collect()}
    assert {i: r["url"] for i, r in got.items()} == urls and all(r["kind"] == "response" for r in got.values())
    whole = sample_archive(spark, tmp_path)
    second = list(warc.salvage(whole))[1].start
    out = list(warc.salvage(whole[: whole.index(b"\r\n", 40) + 2] + whole[second:]))  # headers that run into the next record
    assert [type(x).__name__ for x in out] == ["Gap"] + ["Record"] * 5


def test_warc_damaged_headers(spark, tmp_path):
    """Damaged digests and lengths are gaps, not errors, and cost no other record."""
    big = "z" * 1500
    pages = pages_of(spark, [(1, "u1", big), (2, "u2", big), (3, "u3", "three")]).coalesce(1)
    warc.write(pages, f"file://{tmp_path}/a")
    whole = b"".join(p.read_bytes() for p in sorted((tmp_path / "a").glob("*.txt")))
    kinds = [r.headers["warc-type"] for r in warc.salvage(whole)]
    revisit = list(warc.salvage(whole))[kinds.index("revisit")]
    for old, new in ((b"Digest: sha1:", b"Digest: sha1:!"), (b"Payload-Length: ", b"Payload-Length: x"), (b"Payload-Length: ", "Payload-Length: ²".encode())):
        at = whole.index(old, revisit.start)
        damaged = whole[:at] + new + whole[at + len(old) :]
        (tmp_path / "b").mkdir(exist_ok=True)
        (tmp_path / "b" / "x.txt").write_bytes(damaged)
        got = warc.read(spark, f"file://{tmp_path}/b").collect()
        assert sorted(r["kind"] for r in got) == ["gap", "response", "response"]
    at = whole.index(b"Payload-Length: 5")
    out = list(warc.salvage(whole[:at] + b"Payload-Length: 6" + whole[at + 17 :]))
    assert sum(isinstance(x, warc.Gap) for x in out) == 1 and len(out) == 3


def test_warc_large_pages_and_repeated_ids(spark, tmp_path):
    rows = [(1, "u", "p" * 5_000_000), (2, "u", "q" * 300_000), (7, "a", "r" * 2000), (7, "b", "r" * 2000), (3, "c", "r" * 2000), (None, "d", "r" * 2000), (8, "e", "s")]
    got = [(r["page_id"], r["url"], r["kind"], r["refers_to"], r["declared_length"]) for r in warc.archive_round_trip(pages_of(spark, rows), path=f"file://{tmp_path}/w").collect()]
    want = [(p, u, "revisit" if p == 3 else "response", 7 if p == 3 else None, len(h)) for p, u, h in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert max(f.stat().st_size for f in (tmp_path / "w").glob("*.txt")) < 6_000_000


def test_salvage_within_a_member(spark, tmp_path):
    whole = sample_archive(spark, tmp_path)
    damaged = bytearray(whole)
    third = list(warc.salvage(whole))[2]
    damaged[third.start + 20 : third.start + 40] = b"\x00" * 20
    member = warc.gzip_member(bytes(damaged))
    out = list(warc.salvage(member))
    assert [type(x).__name__ for x in out] == ["Gap"] + ["Record"] * 5 and (out[0].start, out[0].end) == (0, len(member))
    cut = warc.gzip_member(whole)[:-20]  # the end of the member is missing
    assert sum(isinstance(x, warc.Record) for x in warc.salvage(cut)) >= 4
    two = list(warc.salvage(warc.gzip_member(whole) + warc.gzip_member(whole)))
    assert len(two) == 12 and two[-1].end == 2 * len(warc.gzip_member(whole))


# URL filter


def slow_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
    tail = rest[end:]
    stop = min([i for c in "?#" if (i := tail.find(c)) >= 0], default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), tail[:stop]


def slow_rule(host, path):
    fits = [r.pattern for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=len, default=None)


URLS = [
    None, "", "no scheme", "http://", "http://A.Example.COM/en/7x?y#z", "x://example.com/en/6", "https://com/en/", "https://notexample.com/en/7", "ftp://a.org/es/?q", "http://h#f/x", "http://h?q=/a", "a://b://c/d",
    "http://example.net/de/8", "http://sub.example.net/de/9", "http://É.Com/en/ü\n/x", "http://xcom/en/",
]


def test_url_rules_and_verdicts(spark):
    pages = spark.read.parquet(f"{SAMPLE}/pages.parquet").select("page_id", "url").unionByName(spark.createDataFrame(list(enumerate(URLS, 10_000)), "page_id long, url string"))
    model = url_filter.fit(url_filter.labelled(spark))
    verdicts = {r.pattern: r.verdict for r in URL_RULES}
    for r in url_filter.judge(pages.withColumn("host", F.lit("clash")), URL_RULES, model).collect():
        host, path = slow_parts(r["url"])
        rule = slow_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdicts[rule] if rule else "block" if r["block_probability"] >= 0.5 else "allow")


def test_url_model_learns(spark):
    rng = random.Random(4)
    rows = [(f"http://casino{rng.randrange(99)}.example/{rng.randrange(999)}", True) for _ in range(150)] + [(f"http://library{rng.randrange(99)}.example/{rng.randrange(999)}", False) for _ in range(150)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "url string, blocked boolean")
    model = url_filter.fit(df.limit(200))
    test = spark.createDataFrame(rows[200:], "url string, blocked boolean")
    got = url_filter.judge(test, [], model).collect()
    assert sum((r["verdict"] == "block") == r["blocked"] for r in got) >= 0.97 * len(got)


def test_url_labels_held_out(spark):
    """A fit on half of the library's table, judged on the other half, and on hosts of neither."""
    rows = url_labels.rows()
    model = url_filter.fit(spark.createDataFrame(rows[::2], "url string, blocked boolean"))
    got = url_filter.judge(spark.createDataFrame(rows[1::2], "url string, blocked boolean"), [], model).collect()
    assert sum((r["verdict"] == "block") == r["blocked"] for r in got) >= 0.95 * len(got)
    whole = url_filter.fit(url_filter.labelled(spark))
    pages = spark.read.parquet(f"{SAMPLE}/pages.parquet").select("url")
    spam = F.col("host").rlike("cheap-pills|free-bets|spam-farm")
    assert url_filter.judge(pages, [], whole).where((F.col("verdict") == "block") != spam).count() == 0


def test_url_fit_matches_slow_version(spark):
    """Weights against plain loops over n-grams hashed by Spark, after the same steps."""
    rows = url_labels.rows()[:40]
    df = spark.createDataFrame(rows, "url string, blocked boolean")
    model = url_filter.fit(df, buckets=64, sizes=(3,), steps=30)
    grams = {r["url"]: r["x"] for r in df.select("url", url_filter.ngram_buckets(url_filter.host(F.col("url")), url_filter.path(F.col("url")), (3,), 64).alias("x")).collect()}
    weights, bias = [0.0] * 64, 0.0
    count = {b: sum(r[1] == b for r in rows) for b in (True, False)}
    for _ in range(30):
        move, shift = [0.0] * 64, 0.0
        for url, blocked in rows:
            x = grams[url]
            z = sum(weights[i] for i in x) / len(x) ** 0.5 + bias
            error = (1 / (1 + math.exp(-z)) - blocked) * 0.5 / count[blocked]
            for i in x:
                move[i] += error / len(x) ** 0.5
            shift += error
        weights = [w - 10 * (m + 1e-3 * w) for w, m in zip(weights, move, strict=True)]
        bias -= shift
    assert all(abs(a - b) < 1e-9 for a, b in zip(model.weights, [*weights, bias], strict=True))


def test_url_long_and_repeated(spark):
    model = url_filter.fit(url_filter.labelled(spark))
    long = "http://a.example.org/" + "x" * 200_000
    got = url_filter.judge(spark.createDataFrame([(long,), (long,), ("http://com/en/" + "y" * 100_000,)], "url string"), URL_RULES, model).collect()
    assert [len(r["path"]) for r in got] == [200_001, 200_001, 100_004] and got[0] == got[1] and got[2]["verdict"] == "block"


def test_url_edges(spark):
    none = spark.createDataFrame([], "url string, blocked boolean")
    model = url_filter.fit(none)
    assert url_filter.judge(spark.createDataFrame([(None,), ("http://a/b",)], "url string"), URL_RULES, model).where("verdict = 'allow'").count() == 2
    assert url_filter.judge(none, URL_RULES, model).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 3])
def test_masks(radius):
    assert len({m for m in topk.masks(radius)}) == len(topk.masks(radius)) and all(m.bit_count() == radius for m in topk.masks(radius))


def test_components_on_either_side(spark, monkeypatch):
    """Few edges are joined on the driver, with the roots of the distributed rounds."""
    from mnemospark.llm import components as module

    edges = [(i, i + 1) for i in range(-40, 40)] + [(1000 - i, 1000) for i in range(30)] + [(7, 7), (None, 3), (2**62, -(2**62)), (500, 501), (501, 500)]
    df = spark.createDataFrame(edges, "a long, b long")
    few = {r["node"]: r["root"] for r in module.components(df).collect()}
    calls = []
    monkeypatch.setattr(module, "_star", lambda e: calls.append(e))
    assert {r["node"]: r["root"] for r in module.components(df).collect()} == few and not calls
    monkeypatch.undo()
    monkeypatch.setattr(module, "FEW", 3)
    assert {r["node"]: r["root"] for r in module.components(df).collect()} == few
