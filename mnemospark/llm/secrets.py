"""Secret scan: fixed patterns, then a randomness test battery with false-discovery control.

All of it is column expressions over whole texts; no row is shuffled but a histogram of
p-values with a bounded number of bins.

A candidate of the battery is a run of ``LEAST`` or more characters of the base64 alphabets.
Its encoding (decimal, hex, letters of one or both cases, base32, base36, base62, base64) is
inferred from the characters seen. Within that alphabet it must pass tests of randomness:
uniformity of the characters, by chi-squared as the number X of equal pairs; chi-squared of
digits, capitals and small letters; the runs test about the median; and lag-one serial
correlation. Passing them proves little for a short string, so the last figure is
``p_text``: the probability that ordinary text of that length would look as random. It
combines two p-values by Fisher's rule: that of so few equal pairs, when characters are as
uneven as in text, and that of so many digits. For hex it is the chance that letters of text
are all in a to f. Numbers are as uniform in text as in keys, so for decimals it is 1.

X is neither normal nor Poisson at these lengths; its tails are those of the gamma
distribution with the exact mean and variance. False discoveries are controlled by length:
Benjamini-Hochberg over the candidates of the corpus, for each class of lengths apart, sets
the largest ``p_text`` at which the expected share of false discoveries stays at ``fdr``.
So the many short ordinary words cost the long candidates no power.

Defined results: a null text counts as empty and has no spans; repeated rows get equal
results; an empty table gives an empty result; extra columns are kept by :func:`scan`,
whose own columns replace columns of the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, staged

#: kind -> (pattern, group whose length counts, least length); listed order breaks ties.
PATTERNS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
RANDOM = "random"
LEAST = 12
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}+={0,2}"
DIGITS, CAPITALS, SMALL = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: encoding -> (characters it may have, its alphabet for the tests), most special first.
ENCODINGS = {
    "decimal": (r"\A[0-9]+\z", DIGITS),
    "hex": (r"\A(?:[0-9a-f]+|[0-9A-F]+)\z", DIGITS + "abcdef"),
    "base26": (r"\A(?:[a-z]+|[A-Z]+)\z", SMALL),
    "base32": (r"\A[A-Z2-7]+\z", CAPITALS + "234567"),
    "base36": (r"\A(?:[0-9a-z]+|[0-9A-Z]+)\z", DIGITS + SMALL),
    "base52": (r"\A[A-Za-z]+\z", CAPITALS + SMALL),
    "base62": (r"\A[0-9A-Za-z]+\z", DIGITS + CAPITALS + SMALL),
    "base64": (r"\A[0-9A-Za-z+/]+\z", DIGITS + CAPITALS + SMALL + "+/"),
    "base64url": (r"\A[0-9A-Za-z_-]+\z", DIGITS + CAPITALS + SMALL + "-_"),
}
#: Probabilities that two and that three letters drawn from natural text are equal.
PAIR, TRIPLE = 0.066, 0.0054
#: Share of digits in the long runs of ordinary text, and that of a to f among its letters.
DIGIT_SHARE, HEX_SHARE = 0.05, 0.32
#: First lengths of the classes within which false discoveries are controlled.
LENGTHS = (12, 16, 20, 24, 32, 48, 64, 128)
BINS = 400
#: Chi-squared of one and of two degrees of freedom at one in a hundred.
KINDS = {1: 6.63, 2: 9.21}


def _running(values: Column, first: Column) -> Column:
    """``first``, and the sums of it and the values before each other one."""
    start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(values, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]


def sums_before(values: Column) -> Column:
    """The sum of the values before each value, by blocks: appending to an array copies it, so none gets long."""

    def by_blocks(v: Column) -> Column:
        size = F.greatest(F.lit(1), F.sqrt(F.size(v)).cast("int"))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / size).cast("int")), lambda k: F.slice(v, k * size + 1, size))

        def joined(b: Column) -> Column:
            begin = _running(F.transform(b, lambda x: F.aggregate(x, F.lit(0), lambda s, y: s + y)), F.lit(0))
            return F.flatten(F.zip_with(b, begin, _running))

        return let(blocks, joined)

    return let(values, by_blocks)


def _found(text: Column, pattern: str, group: int, least: int, kind: str, order: int) -> Column:
    """Spans of the leftmost non-overlapping matches, in code points.

    The pieces that ``split`` leaves between the matches give their places.
    """

    def spans(hits: Column) -> Column:
        long_enough = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits

        def place(pieces: Column) -> Column:
            rows = F.zip_with(F.slice(pieces, F.lit(1), F.size(hits)), F.arrays_zip(hits.alias("hit"), long_enough.alias("part")), lambda p, h: F.struct(F.length(p).alias("gap"), F.length(h["hit"]).alias("n"), F.length(h["part"]).alias("part"), h["hit"].alias("hit")))

            def spans_of(rows: Column) -> Column:
                begin = sums_before(F.transform(rows, lambda r: r["gap"] + r["n"]))
                return F.zip_with(rows, begin, lambda r, at: F.struct((at + r["gap"]).alias("start"), F.lit(order).alias("ord"), (at + r["gap"] + r["n"]).alias("end"), F.lit(kind).alias("kind"), r["hit"].alias("hit"), (r["part"] >= least).alias("keep")))

            return F.filter(let(rows, spans_of), lambda s: s["keep"])

        nothing = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string,hit:string,keep:boolean>>")
        return F.when(F.size(hits) > 0, let(F.split(text, pattern, -1), place)).otherwise(nothing)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def normal_cdf(z: Column) -> Column:
    """Abramowitz and Stegun 26.2.17, within 7.5e-8."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    tail = F.exp(-z * z / 2) * 0.3989422804014327 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z > 0, 1 - tail).otherwise(tail)


def gamma_z(x: Column, mean: Column, variance: Column) -> Column:
    """Normal score of x in the gamma distribution with this mean and variance (Wilson and Hilferty)."""
    shape = mean * mean / variance
    return 3 * F.sqrt(shape) * (F.pow(x / mean, F.lit(1 / 3)) - 1 + 1 / (9 * shape))


def kinds_fit(body: Column, n: Column, alphabet: str) -> Column:
    """Whether the numbers of digits, capitals and small letters are what the alphabet gives."""
    sizes = [(p, sum(c in kind for c in alphabet)) for p, kind in (("[0-9]", DIGITS), ("[A-Z]", CAPITALS), ("[a-z]", SMALL))]
    sizes = [(p, size) for p, size in sizes if size]
    if len(sizes) < 2:
        return F.lit(True)
    out = F.lit(0.0)
    for pattern, size in sizes:
        expected = n * size / sum(x for _, x in sizes)
        out = out + F.pow(F.regexp_count(body, F.lit(pattern)) - expected, F.lit(2)) / expected
    return out < KINDS[len(sizes) - 1]


def p_of_digits(digits: Column, n: Column) -> Column:
    """Chernoff's bound on the chance of so many digits among n characters of ordinary text."""
    share = digits / n
    other = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - DIGIT_SHARE))).otherwise(F.lit(0.0))
    return F.when(share > DIGIT_SHARE, F.exp(-n * (share * F.log(share / DIGIT_SHARE) + other))).otherwise(F.lit(1.0))


def p_text(encoding: Column, equal: Column, n: Column, digits: Column, letters: Column) -> Column:
    """Chance that ordinary text has as few equal pairs and as many digits."""
    pairs = n * (n - 1) / 2
    variance = pairs * (PAIR - PAIR**2) + n * (n - 1) * (n - 2) * (TRIPLE - PAIR**2)
    both = normal_cdf(gamma_z(equal + 0.5, pairs * PAIR, variance)) * p_of_digits(digits, n)
    return F.when(encoding == "decimal", 1.0).when(encoding == "hex", F.pow(F.lit(HEX_SHARE), letters)).otherwise(F.least(F.lit(1.0), both * (1 - F.log(F.greatest(both, F.lit(1e-300))))))


def battery(token: Column) -> Column:
    """Struct of encoding, fit of the kinds, z of uniformity, runs and serial tests, and p_text; null if no encoding fits."""
    body = F.rtrim(token, F.lit("="))
    out = F.lit(None)
    for name, (allowed, alphabet) in reversed(ENCODINGS.items()):
        own = F.when(F.upper(body) == body, F.lower(body)).otherwise(body) if name in ("hex", "base26", "base36") else body
        out = F.when(body.rlike(allowed), F.struct(F.lit(name).alias("encoding"), own.alias("body"), F.lit(alphabet).alias("alphabet"), kinds_fit(own, F.length(body).cast("double"), alphabet).alias("kinds"))).otherwise(out)

    def tests(e: Column) -> Column:
        def over(v: Column) -> Column:
            n, k = F.size(v).cast("double"), F.length(e["alphabet"]).cast("double")
            counts = F.transform(F.sequence(F.lit(1), F.length(e["alphabet"])), lambda a: F.size(F.filter(v, lambda x: x == a)).cast("double"))
            equal = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * (c - 1) / 2)
            mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n
            square = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
            pairs = F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda a, b: F.struct(a.cast("double").alias("a"), b.cast("double").alias("b")))
            high = F.size(F.filter(v, lambda x: x * 2 > k)).cast("double")

            def figures(f: Column) -> Column:
                equal, mean, square, high, changes, products = (f[x] for x in ("equal", "mean", "square", "high", "changes", "products"))
                runs_mean = 2 * high * (n - high) / n + 1
                runs_var = (runs_mean - 1) * (runs_mean - 2) / (n - 1)
                variance = square - n * mean * mean
                serial = F.when(variance > 0, (products - (n - 1) * mean * mean) / variance * F.sqrt(n))
                expected = n * (n - 1) / 2 / k
                digits, letters = (F.regexp_count(e["body"], F.lit(x)) for x in ("[0-9]", "[A-Za-z]"))
                return F.struct(
                    e["encoding"].alias("encoding"),
                    e["kinds"].alias("kinds"),
                    gamma_z(equal, expected, expected * (1 - 1 / k)).alias("z_uniform"),
                    F.when(runs_var > 0, (changes + 1 - runs_mean) / F.sqrt(runs_var)).alias("z_runs"),
                    serial.alias("z_serial"),
                    p_text(e["encoding"], equal, n, digits.cast("double"), letters.cast("double")).alias("p_text"),
                )

            f = F.struct(
                equal.alias("equal"), mean.alias("mean"), square.alias("square"), high.alias("high"),
                F.size(F.filter(pairs, lambda p: (p["a"] * 2 > k) != (p["b"] * 2 > k))).cast("double").alias("changes"),
                F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["a"] * p["b"]).alias("products"),
            )
            return let(f, figures)

        return let(F.transform(F.split(e["body"], ""), lambda c: F.instr(e["alphabet"], c)), over)

    return let(out, lambda e: F.when(e.isNotNull(), tests(e)))


def looks_random(b: Column, z: float = 3.29) -> Column:
    """No test rejects randomness at the two-sided level of ``z``."""
    return F.coalesce((b["z_uniform"] < z) & b["kinds"] & (F.abs(b["z_runs"]) < z) & (F.abs(b["z_serial"]) < z), F.lit(False))


def _bin(p: Column) -> Column:
    """-10 log10 p, in whole numbers: the grid on which the threshold is exact."""
    return F.least(F.lit(BINS), F.floor(-10 * F.log10(F.greatest(p, F.lit(1e-40))))).cast("int")


def _class(n: Column) -> Column:
    """Number of the class of lengths."""
    out = F.lit(0)
    for least in LENGTHS[1:]:
        out = out + F.when(n >= least, 1).otherwise(0)
    return out


def _thresholds(tested: DataFrame, fdr: float) -> list[int]:
    """For each class of lengths the least bin that Benjamini-Hochberg accepts; BINS + 1 if none.

    The histogram has (BINS + 1) * len(LENGTHS) rows at most, however large the corpus.
    """
    counts = {(r["class"], r["bin"]): r["count"] for r in tested.select(F.explode("candidates").alias("c")).groupBy("c.class", "c.bin").count().where("bin is not null").collect()}
    out = []
    for k in range(len(LENGTHS)):
        total, seen, least = sum(n for (c, _), n in counts.items() if c == k), 0, BINS + 1
        for b in range(BINS, -1, -1):
            seen += counts.get((k, b), 0)
            if counts.get((k, b)) and 10 ** (-b / 10) <= fdr * seen / total:
                least = b
        out.append(least)
    return out


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def scan(docs: DataFrame, fdr: float = 0.01, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, base_spans and spans: arrays of (start, ord, end, kind, hit), sorted.

    Base spans come from the fixed patterns. The battery adds spans of kind ``random``
    that overlap none of them.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.array_sort(F.concat(*[_found(text, p, g, n, kind, i) for i, (kind, (p, g, n)) in enumerate(PATTERNS.items())]))
    found = _found(text, CANDIDATE, 0, LEAST, RANDOM, len(PATTERNS))

    def rated(c: Column) -> Column:
        return let(battery(c["hit"]), lambda b: F.struct(c["start"].alias("start"), c["ord"].alias("ord"), c["end"].alias("end"), c["kind"].alias("kind"), c["hit"].alias("hit"), looks_random(b).alias("random"), _bin(b["p_text"]).alias("bin"), _class(c["end"] - c["start"]).alias("class")))

    tested = staged(docs.select(*keep, base.alias("base_spans"), F.transform(found, rated).alias("candidates")), "secrets")
    least = F.array(*[F.lit(x) for x in _thresholds(tested, fdr)])

    def added(base: Column) -> Column:
        hit = F.filter(F.col("candidates"), lambda c: c["random"] & (c["bin"] >= F.element_at(least, c["class"] + 1)) & ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
        return F.array_sort(F.concat(base, F.transform(hit, lambda c: F.struct(c["start"].alias("start"), c["ord"].alias("ord"), c["end"].alias("end"), c["kind"].alias("kind"), c["hit"].alias("hit"), F.lit(True).alias("keep")))))

    return tested.select(*keep, "base_spans", added(F.col("base_spans")).alias("spans"))
