"""A small labelled table of URLs, made by a rule from word lists; all hosts are invented.

Spam hosts join a lure and a trade; plain hosts join a place and an institution, or are
syllables without a meaning. Either kind comes with the same schemes, subdomains, top-level
domains and paths, so that only the words tell them apart.
"""

from __future__ import annotations

import hashlib
from itertools import product

LURES = ("cheap", "free", "best", "hot", "fast", "easy", "instant", "discount", "secret", "mega")
TRADES = ("pills", "bets", "casino", "poker", "loans", "replica", "porn", "cams", "spam", "farm", "clicks", "warez", "keygen", "slots", "escorts", "betting")
PLACES = ("city", "river", "north", "open", "green", "public", "old", "national", "daily", "west")
HOUSES = ("library", "museum", "news", "journal", "school", "garden", "weather", "recipes", "science", "history", "council", "archive", "docs", "forum", "research", "music")
SYLLABLES = ("the", "ran", "ti", "on", "ly", "ther", "sta", "mer", "lo", "vin", "ed", "or", "sh", "wh", "in", "al")
SECTIONS = ("en", "de", "fr", "es", "a", "item", "page", "p", "view", "blog")


def _pick(key: str, choices: tuple[str, ...]) -> str:
    return choices[int.from_bytes(hashlib.sha256(key.encode()).digest()[:4], "big") % len(choices)]


def _url(name: str) -> str:
    sub, tld = _pick(f"sub {name}", ("", "www.", "m.", "blog.")), _pick(f"tld {name}", ("com", "net", "org", "example.com", "example.net", "example.org"))
    number = int.from_bytes(hashlib.sha256(name.encode()).digest()[:2], "big") % 1000
    return f"{_pick(f's {name}', ('http', 'https'))}://{sub}{name}.{tld}/{_pick(f'path {name}', SECTIONS)}/{number}{_pick(f'end {name}', ('', '/', '?page=2', '#top'))}"


def rows() -> list[tuple[str, bool]]:
    """(url, blocked), in an order that says nothing of the label."""
    spam = [_pick(f"join {a}{b}", ("-", "")).join((a, b)) for a, b in product(LURES, TRADES)]
    plain = [_pick(f"join {a}{b}", ("-", "")).join((a, b)) for a, b in product(PLACES, HOUSES)]
    plain += [a + b + _pick(f"third {a}{b}", ("", *SYLLABLES)) for a, b in product(SYLLABLES, SYLLABLES)]
    out = [(_url(x), True) for x in spam] + [(_url(x), False) for x in plain]
    return sorted(out, key=lambda r: hashlib.sha256(r[0].encode()).digest())
