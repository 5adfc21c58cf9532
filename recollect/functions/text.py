"""Text functions as column expressions: token estimates, terms, patterns with ASCII word borders, escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word border between ASCII word characters and others; Java's own border also counts letters beyond ASCII.
ASCII_BORDER = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def re_ascii(pattern: str) -> str:
    """The pattern with ``\\b`` meaning a border of ASCII words."""
    return pattern.replace(r"\b", ASCII_BORDER)


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(re_ascii(pattern))


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(re_ascii(pattern)))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def tokens_packed(text: Column) -> Column:
    """Estimate used when packing: UTF-16 units by 1.6, 2.5 or 4 a token, by script."""
    units = F.length(text) + F.regexp_count(text, F.lit("[\\x{10000}-\\x{10FFFF}]"))
    each = F.when(text.rlike("[\\u4E00-\\u9FAF\\u3041-\\u3096\\u30A1-\\u30FA\\uAC00-\\uD7A3]"), 1.6).when(text.rlike("[\\u0400-\\u04FF\\u0590-\\u05FF\\u0600-\\u06FF]"), 2.5).otherwise(4.0)
    return F.ceil(units / each).cast("long")


def tokens_floor(text: Column) -> Column:
    """Estimate used by the gate and by compaction: a quarter of the code points, at least 1."""
    return F.greatest(F.floor(F.length(text) / 4), F.lit(1)).cast("long")


def tokens_ceil(text: Column) -> Column:
    """Estimate of authored nodes: a quarter of the code points, rounded up, at least 1."""
    return F.greatest(F.ceil(F.length(text) / 4), F.lit(1)).cast("long")


def tokens_words(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(text, "(?U)\\s+"), lambda x: x != "")).cast("long")


def terms(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and underscores."""
    return long_terms(text, 1)


def long_terms(text: Column, least: int = 3) -> Column:
    """Terms of so many characters or more. They are searched for: parting a text at everything else takes several times as long."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[a-z0-9_]{{{least},}}"), F.lit(0))


def keywords(text: Column) -> Column:
    """Distinct terms of three characters or more."""
    return F.array_distinct(long_terms(text))


def keywords_among(have: Column) -> Column:
    """Distinct ones of three characters or more among terms."""
    return F.filter(F.array_distinct(have), lambda x: F.length(x) >= 3)


def coverage(words: Column, text: Column) -> Column:
    """Share of the keywords that occur among the text's terms; 0 without keywords."""
    return covered(words, terms(text))


def covered(words: Column, have: Column) -> Column:
    """Share of the keywords that occur among terms; 0 without keywords."""
    found = F.size(F.array_intersect(words, have))
    return F.coalesce(F.try_divide(found.cast("double"), F.size(words)), F.lit(0.0))


def one_line(text: Column) -> Column:
    """White space of any kind as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


def xml_text(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def xml_attribute(text: Column) -> Column:
    return F.replace(xml_text(text), F.lit('"'), F.lit("&quot;"))


def snippet(text: Column, most: int = 220) -> Column:
    flat = one_line(text)
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def file_name(text: Column) -> Column:
    """The text with every run of other characters than letters, digits, dot, underscore and dash as one underscore."""
    return F.regexp_replace(text, "[^a-zA-Z0-9._-]+", "_")


def content_text(parts: Column) -> Column:
    """Text of a message of typed parts: the text ones joined by line breaks, trimmed."""
    texts = F.transform(F.filter(parts, lambda p: p["type"].isin("text", "input_text", "output_text")), lambda p: p["text"])
    return F.regexp_replace(F.array_join(texts, "\n"), "(?U)^\\s+|\\s+$", "")


def number(value: Column) -> Column:
    """A number from a JSON value as text: numbers and numeric strings, anything else null."""
    return F.regexp_replace(F.trim(value), '^"|"$', "").try_cast("double")


def eviction_priority(idle_ms: Column, size: Column, uses: Column, k: float = 1.2e11) -> Column:
    """How soon an unused model goes: idle time times size, less the more it was used."""
    return idle_ms * size / (k * (1 + F.log(uses + 1.0)))


def fnv64(text: Column) -> Column:
    """The 64-bit FNV-1a hash of a text's UTF-8 bytes as 16 hexadecimal digits.

    The hash is kept as four numbers of 16 bits: its prime is 2**40 + 435, so a step multiplies each by 435, adds those that 40 bits shift into
    the upper two, and carries.
    """
    digits = F.hex(text.cast("binary"))
    places = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    codes = F.transform(places, lambda i: F.conv(F.substring(digits, i, 2), 16, 10).cast("long"))
    basis = F.array(*[F.lit(0xCBF29CE484222325 >> s & 0xFFFF).cast("long") for s in (0, 16, 32, 48)])
    low = lambda x: x.bitwiseAND(F.lit(0xFFFF))
    up = lambda x, n: F.shiftright(x, n)

    def carried(p: Column) -> Column:
        # p: the products of the four parts, not yet carried.
        first = p[1] + up(p[0], 16)
        second = p[2] + up(first, 16)
        return F.array(low(p[0]), low(first), low(second), low(p[3] + up(second, 16)))

    def step(h: Column, code: Column) -> Column:
        a = h[0].bitwiseXOR(code)
        return carried(F.array(a * 435, h[1] * 435, h[2] * 435 + low(F.shiftleft(a, 8)), h[3] * 435 + up(a, 8) + low(F.shiftleft(h[1], 8))))

    part = lambda h, i: F.lpad(F.lower(F.hex(h[i])), 4, "0")
    return F.aggregate(codes, basis, step, lambda h: F.concat(part(h, 3), part(h, 2), part(h, 1), part(h, 0)))
