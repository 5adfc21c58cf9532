"""Line dedup: content-defined chunks of lines, repeated chunks removed after byte comparison.

A rolling hash over the last ``WINDOW`` lines with words is taken behind every such line, from the beginning of
the text on, and each window is a chunk (blank lines within it belong to it); so is each line of ``LONG`` or more
words alone. Chunks depend on their own lines only: a passage of two lines with words or more is covered by the
same chunks wherever it stands, and every copy of it but the first goes whole. (Borders at a part of the lines would
be fewer, but whether a passage has one at its ends is up to chance.)

A chunk is repeated if its very bytes occur again anywhere, in this or another document. The occurrence with the least
(doc_id, line) stays, all others go; of one that overlaps the first in its own document only the lines behind the first go.
Each line that goes is left at a lesser (doc_id, line), so no line is lost from the table. Chunks are first matched by a 64-bit hash, which leaves
few; these are then grouped by their bytes.

A row is known by its doc_id and a 64-bit hash of its text, so different texts under one id, or without an id, are
different documents.

Defined cases: a null text counts as empty and comes back as it is; blank lines are kept inside what
stays and never form a chunk alone; null doc_ids come first in the order, texts of one id are ordered by their hashes;
rows with equal id and text stand for one document and are cleaned alike; a text of which nothing stays is the empty
text; an empty table gives no rows; further columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 2
LONG = 50


def cut(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first line, line behind the last and hash of all chunks."""
    lines = [t.split("\n") for t in texts]
    n = np.array([len(x) for x in lines])
    words, first, _, _ = C.word_hashes([line for x in lines for line in x])
    count = np.diff(first)
    # A line's hash is that of its words; chunks that agree in it are compared byte by byte later.
    weights = words * (C.mix(np.arange(len(words), dtype=np.uint64) - np.repeat(first[:-1], count).astype(np.uint64) + np.uint64(1)) | np.uint64(1))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(weights, dtype=np.uint64)])
    h = C.mix(sums[first[1:]] - sums[first[:-1]] + count.astype(np.uint64))
    start = np.concatenate([[0], np.cumsum(n)])
    text_of = np.repeat(np.arange(len(texts)), n)
    filled, long = np.flatnonzero(count), np.flatnonzero(count >= LONG)
    # Windows by their first and last line; none reaches over the end of a text.
    a, b = filled[: max(0, len(filled) - WINDOW + 1)], filled[WINDOW - 1 :]
    inside = text_of[a] == text_of[b]
    rolling = np.zeros(len(a), np.uint64)
    for k in range(WINDOW):
        at = filled[k : k + len(a)]
        rolling += h[at] * (C.mix((at - a).astype(np.uint64) + np.uint64(77)) | np.uint64(1))
    i, j = np.concatenate([a[inside], long]), np.concatenate([b[inside], long]) + 1
    return text_of[i], i - start[text_of[i]], j - start[text_of[i]], np.concatenate([C.mix(rolling[inside]), C.mix(h[long] + np.uint64(77))])


#: What a row is known by.
ROW = ["doc_id", "_x"]


def _known(docs: DataFrame, *more: Column) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("_x"), text.alias("text"), *more)


def _same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["_x"] == b["_x"])


def chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, _x, first, last, hash) of all chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.release()
        for b in batches:
            texts = C.texts_of(b.column(2))
            for i, j in C.grouped(texts):
                k, first, last, h = cut(texts[i:j])
                if len(k):
                    at = pa.array(k)
                    yield pa.RecordBatch.from_arrays([*(b.column(c)[i:j].take(at) for c in range(2)), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(h.view(np.int64))], [*ROW, "first", "last", "hash"])

    return _known(docs).mapInArrow(run, "doc_id long, _x long, first int, last int, hash long")


def _with_bytes(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(hash, row, first, last, bytes) of the given chunks."""
    lines = _known(docs).withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n", -1)).drop("text")
    per = spans.groupBy(*ROW).agg(F.collect_set(F.struct("hash", "first", "last")).alias("spans"))  # a text's own: bounded by its lines
    rows = lines.join(per, _same_row(lines, per)).select(*(lines[c] for c in ROW), "lines", F.explode("spans").alias("s"))
    return rows.select("s.hash", *ROW, "s.first", "s.last", F.array_join(F.slice("lines", F.col("s.first") + 1, F.col("s.last") - F.col("s.first")), "\n").alias("bytes"))


def repeated(docs: DataFrame) -> DataFrame:
    """(row, first, last) of the chunks to remove: every occurrence but the first of bytes that occur again."""
    found = chunks(docs)
    many = C.saved(found.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"))
    again = C.saved(C.spread(found, many.select("hash"), "hash", C.hot(many, "hash"), [*ROW, "first"]))
    place = F.struct(*ROW, "first", "last")
    # Behind the first occurrence, where the two overlap.
    same = F.struct(*ROW).eqNullSafe(F.struct(*(F.col(f"at.{c}").alias(c) for c in ROW)))
    rest = [*ROW, F.when(same, F.greatest("first", "at.last")).otherwise(F.col("first")).alias("first"), "last"]
    # Occurrences are brought together by their bytes and counted before they move, so that a passage of many documents stays small.
    bytes_of = _with_bytes(docs, again).groupBy("hash", "bytes").agg(F.min(place).alias("at"), F.count("*").alias("n"))
    checked = C.saved(bytes_of.groupBy("hash").agg(F.count("*").alias("kinds"), F.min("at").alias("at"), F.sum("n").alias("n")))
    out = C.spread(again, checked.where("kinds = 1").select("hash", "at"), "hash", C.hot(checked, "hash"), [*ROW, "first"]).where(~place.eqNullSafe(F.col("at"))).select(*rest)
    collided = checked.where("kinds > 1").select("hash")
    if not collided.isEmpty():  # different bytes of one hash: told apart by the bytes themselves
        rows = _with_bytes(docs, again.join(collided, "hash", "left_semi"))
        first = rows.groupBy("hash", "bytes").agg(F.min(place).alias("at"))
        out = out.unionByName(rows.join(first, ["hash", "bytes"]).where(~place.eqNullSafe(F.col("at"))).select(*rest))
    return out.distinct()


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents with all their columns, repeated chunks taken out of ``text``, and ``_removed_lines``."""
    gone = repeated(docs).groupBy(*ROW).agg(F.collect_list(F.struct("first", "last")).alias("gone"))  # a text's own: bounded by its lines
    packed = _known(docs, F.struct("*").alias("row"))
    joined = packed.join(gone, _same_row(packed, gone), "left")
    lines = F.split("text", "\n", -1)
    keep = F.filter(lines, lambda x, i: ~F.exists(gone["gone"], lambda g: (g["first"] <= i) & (i < g["last"])))
    same = gone["gone"].isNull() | F.col("text").isNull()
    text = F.when(same, F.col("text")).otherwise(F.array_join(keep, "\n"))
    n = F.when(same, F.lit(0)).otherwise(F.size(lines) - F.size(keep))
    done = joined.select("row", text.alias("clean"), n.alias("removed"))
    return done.select(*[F.col("clean").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns], F.col("removed").alias("_removed_lines"))
