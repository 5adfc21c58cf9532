"""Approximate search by an inverted file: vectors in lists around centroids, of which a query reads the nearest few.

The centroids are fitted on a sample of at most ``SAMPLE`` vectors, those of least hash (all of them, where there are fewer); every
vector is then put into the list of its nearest centroid. How many lists a query must probe depends on how far the vectors fall into clusters, so it is
fitted too: ``ASKED`` vectors of the sample are searched for among all others of it, and enough lists are probed that the
share ``target`` of their exact results lies in them. Within a list it is the exact search by tiles, so that a list of very many vectors is
dealt over several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField

from . import retrieve

#: Vectors that centroids and probes are fitted on, at most; they and the centroids are all that the driver holds.
SAMPLE = 20_000
ASKED = 500
ROUNDS = 10


class Fitted(NamedTuple):
    centroids: np.ndarray
    probes: int


def fit(records: DataFrame, lists: int = 64, k: int = 10, target: float = 0.95, sample: int = SAMPLE) -> Fitted:
    """``lists`` unit centroids (fewer for fewer different vectors) of a sample of the records (id, vector), and the lists to probe."""
    rows = records.where("vector is not null").orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow()
    if not rows.num_rows:
        return Fitted(np.empty((0, 0)), 0)
    x = retrieve._unit(retrieve._matrix(rows["vector"]))
    # The first centroids are spread: each next one is the vector farthest from those before it.
    first, far = [0], 1 - x @ x[0]
    while len(first) < min(lists, len(x)) and far.max() > 1e-9:
        first.append(int(far.argmax()))
        far = np.minimum(far, 1 - x @ x[first[-1]])
    centroids = x[first].copy()
    for _ in range(ROUNDS):
        own = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        full = np.bincount(own, minlength=len(centroids)) > 0
        centroids[full] = retrieve._unit(sums[full])
    return Fitted(centroids, _probes(x, centroids, k, target))


def _probes(x: np.ndarray, centroids: np.ndarray, k: int, target: float) -> int:
    """How many lists hold the share ``target`` of the k nearest of the first vectors of the sample."""
    k = min(k, len(x) - 1)
    if k < 1:
        return 1
    asked = x[:ASKED]
    score = asked @ x.T
    score[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    best = np.argpartition(-score, k - 1, axis=1)[:, :k]
    own = (x @ centroids.T).argmax(axis=1)
    places = np.argsort(np.argsort(-(asked @ centroids.T), axis=1, kind="stable"), axis=1, kind="stable")
    needed = np.sort(places[np.arange(len(asked))[:, None], own[best]].ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) + 1


def nearest_lists(rows: DataFrame, centroids: np.ndarray, n: int) -> DataFrame:
    """Rows with ``lists``: the numbers of their vector's n nearest centroids, nearest first."""
    schema = rows.schema.add(StructField("lists", ArrayType(IntegerType())))
    at = rows.columns.index("vector")
    n = min(n, len(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows or not n:
                continue
            score = retrieve._unit(retrieve._matrix(pa.chunked_array([b.column(at)]))) @ centroids.T
            best = np.argsort(-score, axis=1, kind="stable")[:, :n].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(best) + 1, dtype=np.int32) * n), pa.array(best.ravel()))], [*b.schema.names, "lists"])

    return rows.where("vector is not null").mapInArrow(run, schema)


def indexed(records: DataFrame, fitted: Fitted) -> DataFrame:
    """Every record (id, vector, collection) with the ``list`` it belongs to; to be written partitioned by it where it is searched often."""
    return nearest_lists(records.select("id", "vector", "collection"), fitted.centroids, 1).withColumn("list", F.get("lists", F.lit(0))).drop("lists")


def search(index: DataFrame, fitted: Fitted, queries: DataFrame, k: int = 10, probes: int | None = None, exclude_self: bool = True) -> DataFrame:
    """(query_id, rank, id, collection, score) of the k best of each query among the lists that it probes (as many as were fitted)."""
    asked = nearest_lists(queries.select("query_id", "vector"), fitted.centroids, probes or fitted.probes)
    # A query stands once for each list it probes; the answers of all its lists are ranked together.
    return retrieve.top_k(index, asked.select("query_id", "vector", F.explode("lists").alias("list")), k, exclude_self=exclude_self, within="list")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, hits, wanted): how many of a query's exact results were found."""
    hits = exact.select("query_id", "id", "collection").join(found.select("query_id", "id", "collection", F.lit(1).alias("_hit")), ["query_id", "id", "collection"], "left")
    return hits.groupBy("query_id").agg(F.count("_hit").alias("hits"), F.count("*").alias("wanted"))
