"""N-gram Jaccard self-join by chosen paths, with exact verification.

Texts are sets of word shingles; each set is embedded as ``SKETCH`` (position, MinHash)
tokens, so that the share of equal tokens estimates Jaccard similarity. The join splits
all sets recursively on sampled shared tokens: a bucket holds the sets that share its path
of tokens; buckets of more than ``SMALL`` sets are split again, each on positions that
a hash of its path samples (1 / ``SPLIT`` of one on average more than one each), buckets that
are small, or ``DEPTH`` deep, are compared by brute force. ``RUNS`` runs start at
different positions: a pair at the threshold shares 0.8 * RUNS first tokens and is missed
only if its path ends in every one of them (below 1e-3 even where every bucket is split).

Brute force within a bucket only says which sets hang together by their sketches (estimate
``LIKELY`` or more); every pair within what hangs together is then compared by its real
shingle sets. Neither step gives out pairs: a tile of a bucket returns a spanning
forest and counts, so a group of n near copies makes about n rows. Large buckets and groups
are cut into tiles of ``TILE`` sets against ``TILE`` sets, each a unit of work.

Equal texts are one set, numbered once and written down before the join begins; results have a row for each document.
What belongs to a text is joined by the text's digest, never by doc_id, so different texts under one id stay apart.

Defined cases: a null text counts as empty; texts without words make one class, linked to nothing else; a text of fewer
than five words has one shingle of all its words; rows without a doc_id have results like all others, but give no class
its name unless no row of it has one (then it is null); repeated rows of one doc_id count as one document each, in the
class of their text; an empty table gives no rows; further columns are ignored by ``classes`` and kept by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

LEAST = 0.8
SKETCH = 128
RUNS = 24
SMALL = 64
DEPTH = 3
SPLIT = 0.8
#: Standard error of an estimate at 0.8 is 0.035: a pair at the threshold falls below with probability 1e-5.
LIKELY = 0.65
TILE = 256
#: Stands for a doc_id that is null.
NO_ID = -(1 << 63)


def _hashed(*xs) -> np.ndarray:
    h = np.uint64(0x2545F4914F6CDD1D)
    for x in xs:
        h = C.mix((np.asarray(x).astype(np.uint64) + h) * np.uint64(0x9E3779B97F4A7C15))
    return h


def sketches(docs: DataFrame, perms: tuple[np.ndarray, np.ndarray] | None = None, bits: int = 32) -> DataFrame:
    """Rows (doc_id, key, sketch): key is the text's SHA-256, sketch its MinHash tokens (null without words)."""
    perms = perms or C.permutations(SKETCH, seed=23)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.release()
        for b in batches:
            texts = C.texts_of(b.column(2))
            for i, j in C.grouped(texts):
                words, first, _, _ = C.word_hashes(texts[i:j])
                s, at = C.shingle_hashes(words, first)
                signs = C.signatures(s, at, perms, bits)
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], b.column(1)[i:j], pa.array([x.tobytes() if n else None for x, n in zip(signs, np.diff(at), strict=True)], pa.binary())], ["doc_id", "key", "sketch"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("key"), text.alias("text")).mapInArrow(run, "doc_id long, key binary, sketch binary")


def stands(docs: DataFrame, perms: tuple[np.ndarray, np.ndarray] | None = None, bits: int = 32) -> DataFrame:
    """A row for each different text: key, least_id, sketch, n_copies, and id, its number. Checkpointed, so that numbers stay as they are."""
    stand = sketches(docs, perms, bits).groupBy("key").agg(F.min("doc_id").alias("least_id"), F.first("sketch").alias("sketch"), F.count("*").alias("n_copies"))
    return C.saved(stand.withColumn("id", F.monotonically_increasing_id()))


def _first_buckets(sets: DataFrame) -> DataFrame:
    """(id, bucket) of the first tokens of all runs."""
    positions = [int(p) for p in np.random.default_rng(5).permutation(SKETCH)[:RUNS]]
    tokens = F.array(*[F.xxhash64(F.lit(p), F.substring("sketch", 1 + 4 * p, 4)) for p in positions])
    return sets.select("id", F.explode(tokens).alias("bucket"))


def _split(rows: DataFrame) -> DataFrame:
    """(id, bucket) one token further: each bucket samples positions by its path, its sets go where their tokens are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.release()
        for b in batches:
            if not b.num_rows:
                continue
            bucket = b.column(1).to_numpy().view(np.uint64)
            sketch = np.frombuffer(b"".join(b.column(2).to_pylist()), "<u4").reshape(-1, SKETCH)
            for p in range(SKETCH):
                chosen = np.flatnonzero(_hashed(bucket, p) < np.uint64(int((1 << 64) / (SPLIT * SKETCH))))
                if len(chosen):
                    to = _hashed(bucket[chosen], p, sketch[chosen, p]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(chosen)), pa.array(to)], ["id", "bucket"])

    return rows.select("id", "bucket", "sketch").mapInArrow(run, "id long, bucket long")


def _in_large(frontier: DataFrame, counted: DataFrame, most: list) -> DataFrame:
    """The rows (id, bucket) of buckets of more than ``SMALL`` sets. Those of the largest, whose list ``most`` is, are told by it and
    are not joined; it holds all of them unless it is as long as it may be."""
    listed = F.col("bucket").isin(most)
    rows = frontier.where(listed)
    if len(most) < C.HOT_KEYS:
        return rows
    return rows.unionByName(frontier.where(~listed).join(counted.where((F.col("n") > SMALL) & ~listed).select("bucket"), "bucket"))


def leaves(sets: DataFrame) -> DataFrame:
    """(id, bucket, n) of the buckets to compare, each of at least two sets; of buckets with the same sets, one."""
    frontier, found = _first_buckets(sets), None
    for depth in range(DEPTH):
        if depth:
            frontier = C.saved(frontier)
        counted = C.saved(frontier.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.min("id").alias("least"), F.max("id").alias("most")).where("n > 1"))
        done = counted if depth == DEPTH - 1 else counted.where(F.col("n") <= SMALL)
        done = done.groupBy("n", "x", "least", "most").agg(F.min("bucket").alias("bucket"))
        done = done.select("bucket", "n")  # of up to SMALL sets each, but at the last depth
        most = C.hot(counted, "bucket", above=SMALL)
        part = frontier.join(done, "bucket") if depth < DEPTH - 1 else C.in_place(frontier, done, "bucket", most)
        found = part if found is None else found.unionByName(part)
        if depth == DEPTH - 1:
            break
        frontier = _split(_in_large(frontier, counted, most).join(sets, "id"))
    return found.select("id", "bucket", "n")


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that join n nodes as all links (a, b) do."""
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = top(x), top(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _tiled(rows: DataFrame, group: str, blocks) -> DataFrame:
    """Each row once for each tile of its group that it is in: with _tile (group and block pair), and _side, its block (-1 where a block meets itself)."""
    rows = rows.withColumn("_blocks", blocks.cast("int")).withColumn("_side", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other")
    return rows.select("*", other).withColumn("_tile", F.xxhash64(group, F.least("_side", "_other"), F.greatest("_side", "_other"))).withColumn("_side", F.when(F.col("_side") == F.col("_other"), -1).otherwise(F.col("_side")))


def _by_tile(rows: DataFrame, value: str, compare: Callable, schema: str) -> DataFrame:
    """compare(ids, values, sides) of the rows of each tile, tiles one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.release()
        names = [f.split()[0] for f in schema.split(", ")]
        tile, held, out = None, [], []
        for b in batches:
            for t, i, v, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if t != tile:
                    if len(held) > 1:
                        out += compare(*zip(*held, strict=True))
                    tile, held = t, []
                    if len(out) > 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)
                        out = []
                held.append((i, v, s))
        if len(held) > 1:
            out += compare(*zip(*held, strict=True))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

    return rows.select("_tile", "id", value, "_side").repartition("_tile").sortWithinPartitions("_tile", "id").mapInArrow(run, schema)


def _pairs_to_see(sides: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray] | None:
    """Of a tile of two blocks, the rows of either; None for a tile of one block, where all rows meet."""
    s = np.array(sides)
    return None if s[0] < 0 else (np.flatnonzero(s == s[0]), np.flatnonzero(s != s[0]))


def _likely(kind: str) -> Callable:
    """(a, b): a forest of the pairs of a tile whose sketches agree in ``LIKELY`` of their values or more."""

    def compare(ids: tuple, values: tuple, sides: tuple) -> list[tuple[int, int]]:
        sketch = np.frombuffer(b"".join(values), kind).reshape(len(values), -1)
        blocks = _pairs_to_see(sides)
        left, right = blocks or (np.arange(len(ids)),) * 2
        a, b = [], []
        for k, i in enumerate(left.tolist()):
            others = right[k + 1 :] if blocks is None else right
            near = others[(sketch[others] == sketch[i]).sum(axis=1) >= LIKELY * sketch.shape[1]]
            a.append(np.full(len(near), i))
            b.append(near)
        return [(ids[x], ids[y]) for x, y in _forest(len(ids), np.concatenate(a), np.concatenate(b))]

    return compare


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, columns: int = 1 << 13) -> np.ndarray:
    """Sizes of the intersections of the left with the right sets (sorted arrays of distinct hashes)."""
    size = np.array([len(s) for s in sets])
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    for c in range(0, len(values), columns):
        i, j = np.searchsorted(at, [c, c + columns])
        m = np.zeros((len(sets), min(columns, len(values) - c)), np.float32)
        m[row[i:j], at[i:j] - c] = 1
        out += m[left] @ m[right].T
    return out


def _linked(least: float) -> Callable:
    """(id, other or -1, n_links): how many sets of a tile a set is linked to, and a forest of the links."""

    def compare(ids: tuple, values: tuple, sides: tuple) -> list[tuple[int, int, int]]:
        words, first, _, _ = C.word_hashes(list(values))
        s, at = C.shingle_hashes(words, first)
        sets = [np.unique(s[at[k] : at[k + 1]]) for k in range(len(ids))]
        blocks = _pairs_to_see(sides)
        left, right = blocks or (np.arange(len(ids)),) * 2
        size = np.array([len(x) for x in sets], np.float64)
        if len(ids) == 2:
            both = np.array([[len(np.intersect1d(sets[left[0]], sets[right[-1]], assume_unique=True))]], np.float64)
            left, right = left[:1], right[-1:]
        else:
            both = overlaps(sets, left, right).astype(np.float64)
        # Whole numbers against the threshold: 4 of 5 is at least 0.8.
        hit = both >= least * (size[left][:, None] + size[right][None, :] - both) - 1e-9
        if blocks is None and len(ids) > 2:
            hit = np.triu(hit, 1)
        a, b = np.nonzero(hit)
        a, b = left[a], right[b]
        n = np.bincount(a, minlength=len(ids)) + np.bincount(b, minlength=len(ids))
        return [(ids[k], -1, int(n[k])) for k in np.flatnonzero(n).tolist()] + [(ids[x], ids[y], 0) for x, y in _forest(len(ids), a, b)]

    return compare


def _text(docs: DataFrame, *more: Column) -> DataFrame:
    """(key, doc, text) of each row: the text's digest, and the doc_id, which is the least long where it is null."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.unhex(F.sha2(text, 256)).alias("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), text.alias("text"), *more)


def linked(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """A row for each different text: key (its SHA-256), least_id (least doc_id of its documents, null if none has one), n_copies,
    n_links (texts at ``least`` or more), class_id (least doc_id of all texts that hang together), and kept (whether the text stands for
    its class: the one that class_id is of; by key, if ids tie or there are none)."""
    stand = stands(docs)
    near = leaves(stand.where("sketch is not null").select("id", "sketch"))
    return with_classes(docs, stand, near, "<u4", least)


def with_classes(docs: DataFrame, stand: DataFrame, near: DataFrame, kind: str, least: float) -> DataFrame:
    """``linked`` from the texts (key, id, least_id, sketch of values of a ``kind``, n_copies) and buckets (id, bucket, n) in which to look for links."""
    blocks = F.ceil(F.col("n") / (2 * TILE))
    hints = _by_tile(_tiled(near, "bucket", blocks).join(stand.where("sketch is not null").select("id", "sketch"), "id"), "sketch", _likely(kind), "a long, b long")
    groups = C.saved(C.components(hints).select(F.col("node").alias("id"), F.col("label").alias("group")))
    sized = C.saved(groups.groupBy("group").agg(F.count("*").alias("n")))
    groups = C.saved(C.spread(groups, sized, "group", C.hot(sized, "group"), ["id"]))
    named = groups.select("id").join(stand.select("id", "key", F.coalesce("least_id", F.lit(NO_ID)).alias("doc")), "id")
    # One row of each text in a group; rows of one id and text are already together.
    texts = _text(docs).join(named, ["key", "doc"]).groupBy("key", "doc", "id").agg(F.first("text").alias("text")).select("id", "text")
    cut = F.greatest(F.ceil(F.col("n") / TILE), F.lit(1))
    out = C.saved(_by_tile(_tiled(groups, "group", cut).join(texts, "id"), "text", _linked(least), "id long, other long, n_links long"))
    counts = out.where("other < 0").groupBy("id").agg(F.sum("n_links").alias("n_links"))
    labels = C.components(out.where("other >= 0").select(F.col("id").alias("a"), F.col("other").alias("b"))).select(F.col("node").alias("id"), F.col("label").alias("class"))
    rank = F.struct(F.col("least_id").isNull().alias("none"), F.col("least_id").alias("doc"), F.col("key").alias("key"))
    members = C.saved(labels.join(stand.select("id", "key", "least_id"), "id").select("id", "class", rank.alias("rank")))
    best = C.saved(members.groupBy("class").agg(F.min("rank").alias("best"), F.count("*").alias("n")))
    found = C.spread(members, best.select("class", "best"), "class", C.hot(best, "class"), ["id"]).join(counts, "id").select("id", "best", "n_links")
    own = F.coalesce(F.col("best"), rank)
    every = stand.select("id", "key", "least_id", "n_copies").join(found, "id", "left")
    return every.select("key", "least_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), own["doc"].alias("class_id"), (own["key"] == F.col("key")).alias("kept"))


def classes(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """Per document: class_id (least doc_id of all that hang together by links or equal text), text_id (least doc_id of its
    text), n_copies (documents of its text), n_links (different texts at ``least`` or more to its text)."""
    return of_documents(docs, linked(docs, least))


def of_documents(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """The results of ``linked`` for each document."""
    texts = C.saved(texts)
    few = texts.select("key", "class_id", F.col("least_id").alias("text_id"), "n_copies", "n_links")
    rows = _text(docs).select("key", F.col("doc"))
    out = C.spread(rows, few, "key", C.hot(texts, "key", "n_copies"), ["doc"])
    return out.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "class_id", "text_id", "n_copies", "n_links")


def one_of_each(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """Of each class one document, with all its columns: the one with the least doc_id (null last), of several texts of that id the one
    with the least digest, of rows with equal id and text the least by all columns (as JSON)."""
    texts = linked(docs, least)
    packed = _text(docs, F.struct("*").alias("row")).drop("text")
    stays = texts.where("kept").select("key", F.coalesce("least_id", F.lit(NO_ID)).alias("doc"))
    left = packed.join(stays, ["key", "doc"], "left_semi")
    again = C.saved(_text(docs).groupBy("key", "doc").agg(F.count("*").alias("n")).where("n > 1").select("key", "doc"))
    if not again.isEmpty():
        once = left.join(again, ["key", "doc"], "left_semi").groupBy("key", "doc").agg(F.min_by("row", F.to_json("row")).alias("row"))
        left = left.join(again, ["key", "doc"], "left_anti").unionByName(once)
    return left.select("row.*")
