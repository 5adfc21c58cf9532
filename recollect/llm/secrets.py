"""Secrets in texts: three fixed patterns, and strings of high Shannon entropy; functions of Spark's JVM only.

Spans are in code points. Spark has no function that gives the places of matches, so they come from the pieces between them: a text
split at a pattern has one piece more than there are matches, and the lengths before a match add up to its start.

Candidates of the entropy scan are runs of a character class (``CLASSES``) of at least the class's window. The window moves along
a candidate character by character; a fold keeps the count of each character of the class in the window, and
the sum of ``c * log2(c)`` over these counts, which a character that enters or leaves changes by one table entry each. The entropy of
a window is ``log2(window) - sum / window``. The table holds whole numbers (``UNIT`` a bit), so that sums are exact
and thresholds mean the same everywhere. Windows at or above the class's threshold that touch make one span. Candidates that an
entry of ``ALLOWED`` matches are known to be harmless and give none; nor do spans that lie within a span of the fixed patterns or,
for classes further down the list, of an earlier class.

Defined cases: a null text is empty; no span gives an empty list, whose digest is that of no bytes; rows with one id or text are
answered each on their own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind, pattern, the group whose length counts, and the least such length, in the order kinds are listed in.
PATTERNS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    # Greedy runs of a class: those that are too short fall out within the pattern.
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]


class CharClass(NamedTuple):
    kind: str
    pattern: str
    #: Characters counted; what a text has in another case is brought to these if ``fold``.
    alphabet: str
    fold: bool
    window: int
    bits: float


CLASSES = [
    CharClass("entropy16", r"[0-9A-Fa-f]{32,}", "0123456789abcdef", True, 32, 3.2),
    CharClass("entropy64", r"[A-Za-z0-9+/_=-]{24,}", string.ascii_letters + string.digits + "+/_=-", False, 24, 4.0),
]
#: (pattern, exception): a candidate in which the pattern occurs, and the exception (if any) does not, is no secret.
ALLOWED = [
    (r"^[^0-9]*$", r"[A-Z][A-Z]"),  # words run together: no digit, no two capitals side by side
    (r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$", None),  # a UUID
    (r"^sha(1|256|384|512)[-_]", None),  # a published checksum
    (r"(?i)example|placeholder|changeme|dummy|sample", None),
    (r"0123456789|abcdefghijkl|ABCDEFGHIJKL", None),  # an alphabet written out
]
UNIT = 1 << 20


def weights(window: int) -> list[int]:
    """``c * log2(c)`` for each count up to the window's size, in whole ``UNIT`` parts of a bit."""
    return [round(c * math.log2(c) * UNIT) if c else 0 for c in range(window + 1)]


def most_weight(c: CharClass) -> int:
    """A window has the class's entropy if its sum of weights is at most this."""
    return math.floor(c.window * (math.log2(c.window) - c.bits) * UNIT)


#: Entries of a running sum that are appended one by one; longer lists go in blocks of so many.
BLOCK = 256


def _bound(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


def _running(lengths: Column) -> Column:
    """The sum of the entries before each entry, in steps of bounded blocks: appending to one long list would copy it each time."""
    add = lambda s, x: s + x

    def sums(xs: Column, first: Column) -> Column:
        state = F.struct(first.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, state, lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["out"], s["at"]).alias("out")), lambda s: s["out"])

    def by_blocks(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda b: F.slice(xs, b * BLOCK + 1, BLOCK))
        firsts = sums(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), add)), F.lit(0))
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), firsts.alias("f")), lambda z: sums(z["b"], z["f"])))

    return F.when(F.size(lengths) > BLOCK, by_blocks(lengths)).otherwise(sums(lengths, F.lit(0)))


SPANS = "array<struct<start:int,end:int,found:string>>"


def _matches(df: DataFrame, out: str, pattern: str, group: int, least: int) -> DataFrame:
    """``df`` with ``out``: (start, end, found) of the pattern's matches in ``_text`` whose ``group`` has at least ``least`` code points.

    Each step is a column of its own, so that nothing is matched twice; texts without a match only meet the first ``rlike``.
    """
    text, p = F.col("_text"), F.lit(pattern)
    size = F.length
    df = df.withColumn("_has", text.rlike(pattern))
    df = df.withColumn("_found", F.when(F.col("_has"), F.regexp_extract_all(text, p, F.lit(0)))).withColumn("_between", F.when(F.col("_has"), F.transform(F.split(text, pattern, -1), size)))
    df = df.withColumn("_counted", F.when(F.col("_has"), F.transform(F.regexp_extract_all(text, p, F.lit(group)), size)) if group else F.transform("_found", size))
    df = df.withColumn("_lengths", F.zip_with(F.slice("_between", 1, F.size("_found")), F.transform("_found", size), lambda a, b: a + b))
    rows = F.arrays_zip(F.col("_found").alias("found"), F.col("_counted").alias("counted"), _running(F.col("_lengths")).alias("at"), F.slice("_between", 1, F.size("_found")).alias("before"))
    kept = F.filter(rows, lambda r: r["counted"] >= least)
    spans = F.transform(kept, lambda r: F.struct((r["at"] + r["before"]).alias("start"), (r["at"] + r["before"] + size(r["found"])).alias("end"), r["found"].alias("found")))
    return df.withColumn(out, F.coalesce(F.when(F.col("_has"), spans), F.array().cast(SPANS))).drop("_has", "_found", "_between", "_counted", "_lengths")


def _hot(found: Column, c: CharClass) -> Column:
    """(start, end) within a candidate of what its windows of high entropy cover."""
    size, table = len(c.alphabet), F.lit(weights(c.window)).cast("array<bigint>")
    weight = lambda n: F.get(table, n)
    place = lambda ch: (F.instr(F.lit(c.alphabet), ch) - 1).cast("int")
    codes = F.transform(F.split(F.lower(found) if c.fold else found, ""), place)

    def moves(xs: Column) -> Column:
        gone = F.concat(F.array_repeat(F.lit(-1), c.window), F.slice(xs, 1, F.greatest(F.size(xs) - c.window, F.lit(0))))
        return F.zip_with(xs, gone, lambda a, b: F.struct(a.alias("comes"), b.alias("goes")))

    none = F.array().cast("array<struct<start:int,end:int>>")
    zero = F.struct(F.lit([0] * size).cast("array<int>").alias("counts"), F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("i"), F.lit(-1).alias("start"), F.lit(-1).alias("end"), none.alias("out"))
    span = lambda s: F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))

    def step(s: Column, m: Column) -> Column:
        comes, goes = m["comes"], m["goes"]
        went = F.get(s["counts"], goes)  # null before the window is full
        came = F.get(s["counts"], comes) - F.when(comes == goes, 1).otherwise(0)
        total = s["sum"] - F.coalesce(weight(went) - weight(went - 1), F.lit(0)) + weight(came + 1) - weight(came)
        counts = F.transform(s["counts"], lambda x, j: x + F.when(j == comes, 1).otherwise(0) - F.when(j == goes, 1).otherwise(0))
        return _bound(total, lambda t: seen(s, counts, t))

    def seen(s: Column, counts: Column, total: Column) -> Column:
        end = s["i"] + 1
        hot = (end >= c.window) & (total <= most_weight(c))
        apart = hot & (s["end"] < end - c.window)
        return F.struct(
            counts.alias("counts"),
            total.alias("sum"),
            end.alias("i"),
            F.when(apart, end - c.window).otherwise(s["start"]).alias("start"),
            F.when(hot, end).otherwise(s["end"]).alias("end"),
            F.when(apart & (s["end"] >= 0), F.concat(s["out"], span(s))).otherwise(s["out"]).alias("out"),
        )

    return _bound(codes, lambda xs: F.aggregate(moves(xs), zero, step, lambda s: F.when(s["end"] >= 0, F.concat(s["out"], span(s))).otherwise(s["out"])))


def _allowed(found: Column) -> Column:
    out = F.lit(False)
    for pattern, exception in ALLOWED:
        hit = found.rlike(pattern)
        out = out | (hit & ~found.rlike(exception) if exception else hit)
    return out


def _hot_of(candidates: str, c: CharClass) -> Column:
    """(start, end) within the text of the hot parts of those candidates that are not allowed."""
    moved = lambda r: F.transform(_hot(r["found"], c), lambda h: F.struct((r["start"] + h["start"]).alias("start"), (r["start"] + h["end"]).alias("end")))
    return F.flatten(F.transform(F.filter(candidates, lambda r: ~_allowed(r["found"])), moved))


def _outside(spans: Column, others: list[str]) -> Column:
    """Those spans that lie within none of the spans of ``others``."""
    def outside(name: str):
        return lambda s: ~F.exists(name, lambda o: (o["start"] <= s["start"]) & (s["end"] <= o["end"]))

    for name in others:
        spans = F.filter(spans, outside(name))
    return spans


def _listed(kinds: list[str]) -> Column:
    """``kind:start:end`` of all spans by start, then kind as listed, joined by commas."""
    ranked = lambda i: lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end"))
    each = [F.transform(f"_{k}", ranked(i)) for i, k in enumerate(kinds)]
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in kinds]), s["kind"] + 1)
    return F.array_join(F.transform(F.array_sort(F.concat(*each)), lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def spans(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with an array column of spans (start, end, ...) for each kind, named ``_`` and the kind."""
    out = df.withColumn("_text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    for kind, pattern, group, least in PATTERNS:
        out = _matches(out, f"_{kind}", pattern, group, least)
    before = [f"_{p[0]}" for p in PATTERNS]
    for c in CLASSES:
        out = _matches(out, "_candidates", c.pattern, 0, c.window)
        found = out.withColumn("_hot", F.when(F.size("_candidates") > 0, _hot_of("_candidates", c)).otherwise(F.array().cast("array<struct<start:int,end:int>>")))
        out = found.withColumn(f"_{c.kind}", _outside(F.col("_hot"), before)).drop("_candidates", "_hot")
        before.append(f"_{c.kind}")
    return out


def found(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, numbers and digest of the fixed patterns' spans, and the list of all spans."""
    base, kinds = [p[0] for p in PATTERNS], [p[0] for p in PATTERNS] + [c.kind for c in CLASSES]
    rows = spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")))
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in base]
    return rows.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(kinds).alias("spans"), *[F.size(f"_{c.kind}").cast("long").alias(f"n_{c.kind}") for c in CLASSES])
