"""Expressions on text, vectors, time and personal data."""

import datetime as dt
import hashlib
import math

import pytest
from pyspark.sql import functions as F

from mnemospark.functions import pii, temporal, text, vector


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def at(s):
    return F.lit(dt.datetime.fromisoformat(s)) if s else F.lit(None).cast("timestamp")


def test_identity_term(spark):
    assert one(spark, text.identity_term(F.lit(" Ål-ice  B.! 2 ")), text.identity_term(F.lit(None).cast("string"))) == ("lice  b 2", "")


@pytest.mark.parametrize(("a", "b", "want"), [("word", "word", 1.0), ("word", "two words", 4 / 11), ("", "x", 0.0), ("abc", "xyz", 0.0)])
def test_trigram_similarity(spark, a, b, want):
    assert math.isclose(one(spark, text.trigram_similarity(F.lit(a), F.lit(b)))[0], want, abs_tol=0.01)


def test_analyzer_and_word_picker(spark):
    got = one(spark, text.tokens(F.lit("The Cat, and the HAT-trick of 7!")), text.capitalised_words(F.lit("Hi Alice, met Bob! at Acme: ok")))
    assert got == (["cat", "hat", "trick", "7"], ["Alice", "Bob", "Acme"])


def test_display_name(spark):
    got = one(spark, text.display_name(F.lit("alice"), F.lit(None).cast("string")), text.display_name(F.lit("alice"), F.lit("Al")), text.display_name(F.lit("McX"), F.lit("")))
    assert got == ("Alice", "Al", "McX")


def test_cursor_round_trip(spark):
    c = text.encode_cursor(F.lit("2024-01-01T00:00:00"), F.lit("id?>~"))
    encoded, parts = one(spark, c, text.decode_cursor(c))
    assert parts == ["2024-01-01T00:00:00", "id?>~"] and not set(encoded) & set("+/")


def test_hashes(spark):
    assert one(spark, text.cache_key(F.lit("q")))[0] == hashlib.sha256(b"q").hexdigest()[:16]
    df = spark.createDataFrame([("x", None)], "b string, a string")
    assert df.select(text.content_hash("b", "a")).first()[0] == hashlib.sha256(b'{"a":null,"b":"x"}').hexdigest()


def test_cosine(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    zero, three = F.array(F.lit(0.0), F.lit(0.0)), F.array(*[F.lit(1.0)] * 3)
    got = one(spark, vector.cosine_score(a, b), vector.cosine_distance(a, zero), vector.cosine_score(a, three))
    assert math.isclose(got[0], 2**-0.5) and got[1] is None and got[2] == 0.0


@pytest.mark.parametrize(("start", "end", "invalid", "open_end", "closed_end"), [
    (None, None, None, True, True), ("2024-01-01", "2024-02-01", None, False, True), ("2024-02-01", None, None, True, True), ("2024-02-02", None, None, False, False),
    ("2024-01-01", None, "2024-02-01", False, False), ("2024-01-01", None, "2024-03-01", True, True),
])
def test_effective_at(spark, start, end, invalid, open_end, closed_end):
    df = spark.range(1).select(at(start).alias("valid_from"), at(end).alias("valid_to"), at(invalid).alias("invalid_at"))
    t = at("2024-02-01")
    assert tuple(df.select(temporal.effective_at(t), temporal.effective_at(t, True)).first()) == (open_end, closed_end)


@pytest.mark.parametrize(("a", "b", "want"), [(("2024-01-01", "2024-02-01"), ("2024-02-01", None), False), (("2024-01-01", None), ("2024-05-01", "2024-06-01"), True), ((None, None), (None, None), True)])
def test_overlaps(spark, a, b, want):
    assert one(spark, temporal.overlaps(*map(at, a), *map(at, b)))[0] is want


def test_validity_suffix(spark):
    a, b, n = at("2026-01-01"), at("2026-06-01"), at(None)
    assert one(spark, *[temporal.validity_suffix(x, y) for x, y in ((a, b), (a, n), (n, b), (n, n))]) == (" (valid: 2026-01-01 to 2026-06-01)", " (valid: from 2026-01-01)", " (valid: until 2026-06-01)", "")


def test_parse_instant(spark):
    assert one(spark, temporal.parse_instant(F.lit("2024-01-01T10:00:00Z")), temporal.parse_instant(F.lit("soon"))) == (dt.datetime(2024, 1, 1, 10), None)


def masked(spark, s):
    return one(spark, pii.mask(F.lit(s), pii.detect(F.lit(s))))[0]


def test_mask(spark):
    assert masked(spark, "é mail a.b@c.org now") == "é mail [REDACTED:EMAIL] now"
    assert masked(spark, "card 4111 1111 1111 1111.") == "card [REDACTED:CARD]."
    assert masked(spark, "key sk-abcdefghijklmnopqrstuv x") == "key [REDACTED:KEY] x"
    assert masked(spark, "nothing here") == "nothing here"


def test_merge_keeps_the_longer(spark):
    spans = one(spark, pii.detect(F.lit("ssn 123-45-6789")))[0]
    assert [(s["start"], s["end"]) for s in spans] == [(4, 15)]
