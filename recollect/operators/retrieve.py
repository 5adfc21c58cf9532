"""Exact vector retrieval for many queries at once: top-k, several collections, within groups and as of a time, prefix cascade, line ranges.

A few queries (``QUERIES_AT_ONCE``, counted first) go to every task and meet the records where they lie; nothing but each task's k best is
shuffled. More queries than that, and searches within a group, go by tiles: queries and records are dealt to cells of bounded size, each
record once for every tile of queries it has to meet, and cells hand on k rows a query. Either way records are read once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from ..functions import text as T

#: Queries that go to the tasks whole: their number times the vector's size bounds what is broadcast.
QUERIES_AT_ONCE = 4096
#: Rows of each side that meet in a cell.
QUERY_TILE, RECORD_TILE = 4096, 32768
#: Scores that are held at once; several arrays of so many are.
SCORES = 1 << 20


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of an Arrow list column, one a row; without copying them to Python where all have one length."""
    column = column.combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    if len(column) and not column.null_count:
        flat, ends = column.flatten(), column.offsets.to_numpy()
        if not flat.null_count and len(set(np.diff(ends).tolist())) == 1:
            return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.array(column.to_pylist(), np.float64)


def _ordered(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers in the order of the column's values."""
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy()
    values = [tuple(v.values()) if isinstance(v, dict) else v for v in column.to_pylist()]
    at = {v: i for i, v in enumerate(sorted(set(values), key=lambda v: (v is not None, v)))}
    return np.array([at[v] for v in values], np.int64)


def _cut(found: pa.Table, k: int, per_collection: bool) -> pa.Table:
    """The first k of each query (of each collection) by score, then id, then collection.

    Scores that differ by rounding only are one score, as in the final order.
    """
    if k <= 0 or not found.num_rows:
        return found
    by = [_ordered(found["query_id"]), _ordered(found["tier"]), *([_ordered(found["collection"])] if per_collection else [])]
    order = np.lexsort((_ordered(found["collection"]), _ordered(found["id"]), -np.round(found["score"].to_numpy(), 9), *reversed(by)))
    new = np.zeros(len(order), bool)
    new[0] = True
    for x in by:
        new[1:] |= x[order][1:] != x[order][:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return found.take(pa.array(order[np.arange(len(order)) - first < k]))


def _best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k highest finite scores (all for k <= 0), of equal ones those of the first columns: never more, however many tie."""
    if not 0 < k < score.shape[1]:
        return np.nonzero(np.isfinite(score))
    least = np.round(np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k], 9)
    row, col = np.nonzero(score >= least[:, None] - 1e-9)  # by a row's columns in order; few besides the k and ties
    value = score[row, col]
    real = np.isfinite(value)
    row, col, value = row[real], col[real], np.round(value[real], 9)
    above, tied = value > least[row], np.flatnonzero(value == least[row])
    room = k - np.bincount(row[above], minlength=len(score))
    above[tied[np.arange(len(tied)) - np.searchsorted(row[tied], row[tied]) < room[row[tied]]]] = True
    return row[above], col[above]


def _excluded(q: pa.Table, r: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the pairs that a query leaves out."""
    at: dict[tuple, list[int]] = {}
    wanted = {(x["collection"], x["id"]) for xs in q["excluded"].to_pylist() for x in xs or []}
    for j, key in enumerate(zip(r["collection"].to_pylist(), r["id"].to_pylist(), strict=True) if wanted else []):
        if key in wanted:
            at.setdefault(key, []).append(j)
    pairs = [(i, j) for i, xs in enumerate(q["excluded"].to_pylist() if at else []) for x in xs or [] for j in at.get((x["collection"], x["id"]), [])]
    return tuple(np.array(pairs, np.int64).reshape(-1, 2).T)


class _Search:
    """What a search asks for, and how a tile of queries meets a tile of records."""

    def __init__(self, schema: pa.Schema, k: int, per_collection: bool, exclude_self: bool, as_of: str | None, sizes: tuple[int, ...] | None):
        self.schema, self.k, self.per_collection, self.exclude_self, self.as_of, self.sizes = schema, k, per_collection, exclude_self, as_of, sizes

    def none(self) -> pa.Table:
        return self.schema.empty_table()

    def met(self, q: pa.Table, r: pa.Table) -> pa.Table:
        """The best of one group's records for each of its queries. Records stand in the order in which ties are decided."""
        r = r.take(pa.array(np.lexsort((_ordered(r["collection"]), _ordered(r["id"])))))
        left, right = _matrix(q["vector"]), _matrix(r["vector"])
        self_rows = _ordered(pa.chunked_array([*q["query_id"].chunks, *r["id"].chunks])) if self.exclude_self and q["query_id"].type == r["id"].type else None
        drop = _excluded(q, r) if "excluded" in q.column_names else None
        names = _ordered(r["collection"])
        groups = [np.flatnonzero(names == g) for g in np.unique(names)] if self.per_collection else [np.arange(r.num_rows)]
        found = []
        for tier, size in enumerate(self.sizes or (left.shape[1],), 1):
            a, b = _unit(left[:, :size]), _unit(right[:, :size])
            none = [np.flatnonzero(~np.isfinite(x).all(axis=1)) for x in (a, b)]  # vectors that aren't numbers are found by nothing
            step = max(1, SCORES // max(1, len(b)))
            for i in range(0, len(a), step):
                score = a[i : i + step] @ b.T
                score[:, none[1]] = -np.inf
                score[none[0][(none[0] >= i) & (none[0] < i + step)] - i] = -np.inf
                if self_rows is not None:
                    score[self_rows[i : min(i + step, len(a)), None] == self_rows[None, len(a) :]] = -np.inf
                if self.as_of:
                    then, now = r["at"].to_numpy()[None, :], q["at"].to_numpy()[i : i + step, None]
                    score[then > now if self.as_of == "<=" else then >= now] = -np.inf
                if drop is not None:
                    inside = (drop[0] >= i) & (drop[0] < i + step)
                    score[drop[0][inside] - i, drop[1][inside]] = -np.inf
                for at in groups:
                    part = score if len(groups) == 1 else score[:, at]
                    row, col = _best(part, self.k)
                    rows, cols = pa.array(row + i), pa.array(at[col])
                    found.append(pa.table([q["query_id"].take(rows), r["id"].take(cols), r["collection"].take(cols), pa.array(part[row, col]), pa.array(np.full(len(row), tier, np.int32))], schema=self.schema))
        return _cut(pa.concat_tables(found), self.k, self.per_collection)

    def cell(self, q: pa.Table, r: pa.Table) -> pa.Table:
        """All groups of a cell: queries meet the records of their own group."""
        if not q.num_rows or not r.num_rows:
            return self.none()
        if "within" not in q.column_names:
            return self.met(q, r)
        code = _ordered(pa.chunked_array([*q["within"].chunks, *r["within"].chunks]))
        mine, theirs = code[: q.num_rows], code[q.num_rows :]
        mine_at, theirs_at = np.argsort(mine, kind="stable"), np.argsort(theirs, kind="stable")
        mine, theirs = mine[mine_at], theirs[theirs_at]
        out = [self.none()]
        for g in np.intersect1d(mine, theirs):
            rows, cols = (at[np.searchsorted(x, g) : np.searchsorted(x, g, "right")] for x, at in ((mine, mine_at), (theirs, theirs_at)))
            out.append(self.met(q.take(pa.array(rows)), r.take(pa.array(cols))))
        return pa.concat_tables(out)


def _cells(records: DataFrame, queries: DataFrame, n_queries: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with the cells they are dealt to. A group of many rows has several tiles of each side; small groups share cells, a large one shares none."""
    total = records.count()
    if "within" in queries.columns:
        counted = queries.groupBy("within").agg(F.count("*").alias("_nq")).join(records.groupBy("within").agg(F.count("*").alias("_nr")), "within")
        queries, records = queries.join(counted, "within"), records.join(counted, "within")
        large = (F.col("_nr") > RECORD_TILE // 4) | (F.col("_nq") > QUERY_TILE // 4)
        place = F.when(large, F.xxhash64("within")).otherwise(F.pmod(F.xxhash64("within"), F.lit(max(1, total // RECORD_TILE, n_queries // QUERY_TILE))))
    else:
        queries, records = (df.withColumn("_nq", F.lit(n_queries)).withColumn("_nr", F.lit(total)) for df in (queries, records))
        place = F.lit(0).cast("long")
    tiles = lambda n, size: F.greatest(F.ceil(F.col(n) / size), F.lit(1)).cast("int")
    g, h = tiles("_nq", QUERY_TILE), tiles("_nr", RECORD_TILE)
    all_of = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    dealt = lambda key, n: F.pmod(F.xxhash64(*key), n).cast("int")
    queries = queries.withColumn("_cell", place).withColumn("_g", dealt(["query_id"], g)).withColumn("_h", all_of(h)).drop("_nq", "_nr")
    records = records.withColumn("_cell", place).withColumn("_h", dealt(["id", "collection"], h)).withColumn("_g", all_of(g)).drop("_nq", "_nr")
    return queries, records, ["_cell", "_g", "_h"]


def top_k(records: DataFrame, queries: DataFrame, k: int = 10, per_collection: bool = False, exclude_self: bool = True, excluded: DataFrame | None = None, within: str | None = None, as_of: tuple[str, str] | None = None, sizes: tuple[int, ...] | None = None) -> DataFrame:
    """Each query's k records of highest cosine: (query_id, rank, id, collection, score), ties by id (by collection, then id, if equal ids of several collections tie).

    ``records``: id, vector, collection; ``queries``: query_id, vector. k <= 0 gives all. With ``per_collection`` k holds within each collection.

    * ``exclude_self``: a record whose id is the query's is left out. ``excluded`` (query_id, collection, id): so are these. What is left out never takes a place.
    * ``within``: a column of both sides; a query meets only records of its own value (null meets none).
    * ``as_of`` (column, "<=" or "<"): a query meets only records whose column is up to, or before, its own.
    * ``sizes``: the search is made on vector prefixes of each of these sizes, at length 1, in the same pass; ``tier`` (from 1) says which.
    """
    kind = lambda df, c: df.schema[c].dataType
    out = StructType([StructField("query_id", kind(queries, "query_id")), StructField("id", kind(records, "id")), StructField("collection", StringType()), StructField("score", DoubleType()), StructField("tier", IntegerType())])
    extra = [F.col(within).alias("within")] if within else []
    extra += [F.col(as_of[0]).cast("long").alias("at")] if as_of else []
    q, r = queries.select("query_id", "vector", *extra), records.select("id", "vector", F.col("collection").cast("string").alias("collection"), *extra)
    if excluded is not None:
        lists = excluded.groupBy("query_id").agg(F.collect_set(F.struct("collection", "id")).alias("excluded"))
        q = q.join(lists, "query_id", "left")
    if as_of:
        q, r = q.where("at is not null"), r.where("at is not null")
    n = q.count()
    if within or n > QUERIES_AT_ONCE:
        search = _Search(_arrow(out), k, per_collection, exclude_self, as_of and as_of[1], sizes)
        q, r, by = _cells(r, q, n)
        q = q.select(*[F.col(c).alias(c) for c in q.columns])  # both sides may come from one table
        drop = lambda t: t.drop_columns(by)

        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            pa.default_memory_pool().release_unused()  # what the cells before left
            return search.cell(drop(a), drop(b))

        found = q.groupBy(*by).cogroup(r.groupBy(*by)).applyInArrow(run, out)
    else:
        found = _broadcast(r, q, _Search(_arrow(out), k, per_collection, exclude_self, as_of and as_of[1], sizes), out)
    w = Window.partitionBy("query_id", "tier", *(["collection"] if per_collection else [])).orderBy(F.round("score", 9).desc(), "id", "collection")
    ranked = found.withColumn("rank", F.row_number().over(w))
    return (ranked.where(F.col("rank") <= k) if k > 0 else ranked).select("query_id", "rank", "id", "collection", "score", *(["tier"] if sizes else []))


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _broadcast(records: DataFrame, queries: DataFrame, search: _Search, out: StructType) -> DataFrame:
    """Records meet the queries, of which there are ``QUERIES_AT_ONCE`` at most, in place; a task holds its best so far."""
    asked = queries.toArrow()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = search.none()
        for b in batches:
            if b.num_rows and asked.num_rows:
                new = search.cell(asked, pa.Table.from_batches([b]))
                if search.k <= 0:
                    yield from new.to_batches()
                else:
                    held = _cut(pa.concat_tables([held, new]), search.k, search.per_collection)
        yield from held.to_batches()

    return records.mapInArrow(run, out)


def top_k_over_collections(records: DataFrame, queries: DataFrame, k: int = 10, excluded: DataFrame | None = None, exclude_self: bool = True) -> DataFrame:
    """k of each collection, then k of them all by score, collection and id."""
    each = top_k(records, queries, k, per_collection=True, excluded=excluded, exclude_self=exclude_self).drop("rank")
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "collection", "id")
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cascade(records: DataFrame, queries: DataFrame, sizes: tuple[int, int, int] = (16, 32, 64), exits: tuple[float, float] = (0.65, 0.75), k: int = 10) -> DataFrame:
    """Search on vector prefixes: the first size whose best score reaches its exit answers, the last always does; ``tier`` says which.

    All sizes are searched in one pass over the records; a query's k rows of each size are what the choice needs.
    """
    found = top_k(records, queries, k, sizes=sizes)
    exit_ = F.element_at(F.array(*[F.lit(x) for x in (*exits, -2.0)]), F.col("tier"))
    good = F.when(F.round("score", 9) >= exit_, F.col("tier"))
    return found.withColumn("_first", F.coalesce(F.min(good).over(Window.partitionBy("query_id")), F.lit(len(sizes)))).where("tier = _first").drop("_first")


def shaped(results: DataFrame) -> DataFrame:
    """Search results as a host shows them: path, last line, source and citation of (collection, id, text)."""
    enc = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    path = F.concat(enc(F.col("collection")), F.lit("::"), enc(F.col("id").cast("string")))
    lines = F.size(F.split("text", "\n", -1))
    source = F.when(F.col("collection").startswith("session"), "sessions").otherwise("memory")
    return results.withColumn("path", path).withColumn("end_line", lines).withColumn("source", source).withColumn("citation", F.concat("path", F.lit("#L1-L"), lines))


def line_range(text, first: int, lines: int = 200):
    """Lines of a text from the 1-based ``first`` on."""
    return F.array_join(F.slice(F.split(text, "\n", -1), first, lines), "\n")


def asks_for_dreams(text):
    """Whether a query is about dreams."""
    return T.matches(F.lower(text), r"\bdream(?:s|ed|ing)?\b")


def recent_ids(messages: DataFrame, limit: int = 4) -> DataFrame:
    """(session_id, id) of the last ``limit`` messages of each session (by ts_ms, then position), those that have an id: they are not searched for."""
    w = Window.partitionBy("session_id").orderBy(F.desc("ts_ms"), F.desc("position"))
    return messages.withColumn("_back", F.row_number().over(w)).where((F.col("_back") <= limit) & (F.col("id") != "")).select("session_id", "id")


def requests(asked: DataFrame, default_k: int = 8) -> DataFrame:
    """Search requests as the engine reads them: query, k, dream, and the collections to search, in order.

    asked: query, text, input, q (the first that isn't empty is the query; requests without one are left out), k, limit, top_k (the first positive one counts),
    session_id, user_ns. A question about dreams goes to the user's dreams alone.
    """
    first = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("query", "text", "input", "q")])
    k = F.coalesce(*[F.when(F.col(c) > 0, F.greatest(F.floor(c), F.lit(1)).cast("int")) for c in ("k", "limit", "top_k")], F.lit(default_k))
    plain = F.array_compact(F.array(F.concat(F.lit("session:"), F.nullif("session_id", F.lit(""))), F.concat(F.lit("user:"), "user_ns"), F.lit("global")))
    rows = asked.withColumn("_query", first).where("_query is not null").withColumn("_dream", asks_for_dreams(F.col("_query")))
    where = F.when(F.col("_dream"), F.array(F.concat(F.lit("dream:"), "user_ns"))).otherwise(plain)
    return rows.select("request_id", F.col("_query").alias("query"), k.alias("k"), F.col("_dream").alias("dream"), where.alias("collections"))
