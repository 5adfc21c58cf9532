"""Vector functions as column expressions over arrays of doubles.

What is used more than once is bound to a lambda's variable (``bound``): inside a lambda Spark evaluates an expression
again for every entry, and so a whole embedding for each of its own components.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once for each row."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for vectors that are empty, of other lengths, or zero."""

    def of(v: Column) -> Column:
        x, y = v["x"], v["y"]
        return F.when((F.size(x) == F.size(y)) & (F.size(x) > 0), bound(norm(x) * norm(y), lambda n: F.when(n > 0, dot(x, y) / n).otherwise(0.0))).otherwise(0.0)

    return bound(F.struct(a.alias("x"), b.alias("y")), of)


def normalised(a: Column, least: float = 1e-9) -> Column:
    """The vector at length 1; one shorter than ``least`` as it is."""
    return bound(a, lambda v: bound(norm(v), lambda n: F.when(n < least, v).otherwise(F.transform(v, lambda x: x / n))))


def prefix(a: Column, size: int) -> Column:
    """The first ``size`` entries at length 1."""
    return normalised(F.slice(a, 1, size))


def hashed_embedding(text: Column, size: int = 32) -> Column:
    """The deterministic test embedding: SHA-256 bytes of each lower-case word, scaled to [-1, 1], summed, at length 1."""
    digit = lambda h, i: F.instr(F.lit("0123456789abcdef"), F.substring(h, i, 1)) - 1
    sums = F.lit([0] * size).cast("array<int>")
    # Whole numbers are summed, each word hashed once; the scaling comes at the end.
    for_word = lambda s, h: F.transform(s, lambda x, i: x + 16 * digit(h, (i % 32) * 2 + 1) + digit(h, (i % 32) * 2 + 2))

    def of(low: Column) -> Column:
        words = F.filter(F.split(low, "(?U)\\s+"), lambda w: w != "")
        return bound(words, lambda w: summed(F.when(F.size(w) > 0, w).otherwise(F.array(low))))

    def summed(words: Column) -> Column:
        total = F.struct(F.aggregate(F.transform(words, lambda w: F.sha2(w, 256)), sums, for_word).alias("sums"), F.size(words).cast("double").alias("n"))
        return normalised(bound(total, lambda t: F.transform(t["sums"], lambda x: x / 127.5 - t["n"])))

    return bound(F.lower(text), of)


def mean(vectors: Column) -> Column:
    """The mean of an array of vectors of one length."""

    def of(vs: Column) -> Column:
        first = F.transform(vs[0], lambda x: x * 0.0)
        total = F.aggregate(vs, first, lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
        return bound(F.size(vs).cast("double"), lambda n: F.transform(total, lambda x: x / n))

    return bound(vectors, of)


def masked_mean(vectors: Column, mask: Column) -> Column:
    """The mean of those vectors whose entry in ``mask`` is true (all zeros if none is)."""
    zipped = F.arrays_zip(vectors.alias("v"), mask.alias("m"))
    kept = F.transform(F.filter(zipped, lambda x: F.coalesce(x["m"], F.lit(False))), lambda x: x["v"])
    return bound(kept, lambda k: F.when(F.size(k) > 0, mean(k)).otherwise(F.transform(vectors[0], lambda x: x * 0.0)))


def mean_by(rows: DataFrame, keys: list[str], vector: str, size: int, out: str = "mean") -> DataFrame:
    """(keys, ``out``, n): the mean vector of each key. Every component is a plain average, so tasks sum before
    anything is shuffled, and no key's vectors are gathered. Vectors of another length than ``size`` and null ones don't count;
    a key without any has a null mean.
    """
    rows = rows.withColumn("_v", F.when(F.size(vector) == size, F.col(vector)))
    parts = [F.avg(F.get("_v", F.lit(i))).alias(f"_{i}") for i in range(size)]
    means = rows.groupBy(*keys).agg(*parts, F.count("_v").alias("n"))
    return means.select(*keys, F.when(F.col("n") > 0, F.array(*[F.col(f"_{i}") for i in range(size)])).alias(out), "n")
