"""Centroid clustering of whole-number vectors, exact at every step.

Components become ``floor(SCALE * x)``. A block of vectors meets all centroids in one matrix product of doubles,
``|x|^2 - 2 x.c + |c|^2``. Every partial sum of that expansion is a whole number of at most ``dims * (max|x| + max|c|)^2``;
while that is below 2**53 doubles hold it exactly, whatever order BLAS adds in. Blocks beyond that bound are computed in 64-bit
integers, and beyond 2**62 in Python's. A round's sums and counts of each centroid are combined by ``treeAggregate`` as whole
numbers, so what meets in a task is a few small tables however many vectors there are; only centroids reach the driver.

Blocks are packed once as small integers and checkpointed; each round reads only those.

Defined cases: vectors that are null, of another length, or hold a null, NaN or infinity are left out; a null vec_id is
hashed as an empty text; of vectors with one hash (a repeated id) the one with smaller components starts first; equal centroids: the
smaller number takes the vectors, the others stay empty and unchanged; fewer vectors than ``k`` make as many centroids;
an empty table gives no rows; further columns are ignored. Distances and sums above 2**63 - 1 are given as 2**63 - 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from . import common as C

SCALE = 256
LONGEST = (1 << 63) - 1
#: Rows whose distances to all centroids are held at once.
ROWS = 8192


def vectors(column: pa.ListArray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and components of the vectors of a list column that have ``dims`` finite entries."""
    sized = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dims), False).to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(sized)).flatten()
    m = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sized), dims)  # nulls become NaN
    real = np.isfinite(m).all(axis=1)
    return sized[real], m[real]


def pack(x: np.ndarray) -> tuple[str, bytes]:
    """``floor(SCALE * x)`` of a block in the smallest of these forms: 16 or 32-bit integers, else the doubles themselves."""
    most = np.abs(x).max(initial=0.0) * SCALE
    if most < 1 << 31:
        kind = "<i2" if most < 1 << 15 else "<i4"
        return kind, np.floor(x * SCALE).astype(kind).tobytes()
    return "<f8", x.astype("<f8").tobytes()


def unpack(kind: str, data: bytes, dims: int) -> np.ndarray:
    """A block's whole numbers: 64-bit integers, or Python's where they are larger."""
    m = np.frombuffer(data, kind).reshape(-1, dims)
    if kind != "<f8":
        return m.astype(np.int64)
    if np.abs(m).max(initial=0.0) < 1 << 50:
        return np.floor(m * SCALE).astype(np.int64)
    return np.array([[(lambda f: f.numerator // f.denominator)(Fraction(v) * SCALE) for v in row] for row in m.tolist()], object).reshape(m.shape)


def _most(m: np.ndarray) -> int:
    return max((abs(int(m.max())), abs(int(m.min())))) if m.size else 0


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to each vector's nearest centroid (ties: the smaller number), exactly."""
    bound = x.shape[1] * (_most(x) + _most(centroids)) ** 2
    kind = np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 else object
    c = centroids.astype(kind)
    own, others = np.empty(len(x), np.int64), np.empty(len(x), object if kind is object else np.int64)
    c2 = (c * c).sum(axis=1)
    for i in range(0, len(x), ROWS):
        part = x[i : i + ROWS].astype(kind)
        d = (part * part).sum(axis=1)[:, None] - 2 * (part @ c.T) + c2
        own[i : i + ROWS] = at = d.argmin(axis=1)
        others[i : i + ROWS] = d[np.arange(len(d)), at]
    return own, others


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of two tables of whole numbers, in Python's integers where 64 bits might not hold it."""
    if object not in (a.dtype, b.dtype) and _most(a) + _most(b) > LONGEST:
        a = a.astype(object)
    return a + b


def gathered(values: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Row sums of ``values`` by their group number, exactly."""
    if values.dtype == object or _most(values) * len(values) > LONGEST:
        out = np.zeros((k, values.shape[1]), object)
        np.add.at(out, own, values.astype(object))
        return out
    out = np.zeros((k, values.shape[1]), np.int64)
    order = np.argsort(own, kind="stable")
    groups, first = np.unique(own[order], return_index=True)
    if len(groups):
        out[groups] = np.add.reduceat(values[order], first, axis=0)
    return out


def moved(centroids: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Centroids at the componentwise floor of their vectors' mean; those without vectors as they are."""
    full = counts > 0
    out = centroids.astype(object)
    out[full] = sums.astype(object)[full] // counts.astype(object)[full][:, None]
    return out if _most(out) > LONGEST else out.astype(np.int64)


def packed(rows: DataFrame, dims: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Blocks (ids, known, kind, data) of the vectors that count, checkpointed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = vectors(b.column(1), dims)
            if len(at):
                ids = b.column(0).take(pa.array(at))
                kind, data = pack(x)
                yield pa.RecordBatch.from_pydict({"ids": [pc.fill_null(ids, 0).to_numpy().astype("<i8").tobytes()], "known": [pc.is_valid(ids).to_numpy(zero_copy_only=False).tobytes()], "kind": [kind], "data": [data]})

    return C.saved(rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, "ids binary, known binary, kind string, data binary"))


def starting(blocks: RDD, k: int, seed: int, dims: int) -> np.ndarray:
    """The k vectors with least sha256 of ``seed:vec_id``, in that order; only lists of k vectors are combined."""

    def least(best: list[tuple], block: Row) -> list[tuple]:
        ids, known = np.frombuffer(block.ids, "<i8").tolist(), np.frombuffer(block.known, bool).tolist()
        hashes = [hashlib.sha256(f"{seed}:{i if ok else ''}".encode()).hexdigest() for i, ok in zip(ids, known, strict=True)]
        last = sorted(hashes)[min(k, len(hashes)) - 1]  # all that tie with it stay, as components decide then
        at = [i for i, h in enumerate(hashes) if h <= last]
        rows = unpack(block.kind, block.data, dims)[at].tolist()
        return sorted([*best, *zip([hashes[i] for i in at], rows, strict=True)])[:k]

    rows = blocks.treeAggregate([], least, lambda a, b: sorted(a + b)[:k])
    m = np.array([v for _, v in rows], object).reshape(len(rows), dims)
    return m if _most(m) > LONGEST else m.astype(np.int64)


def clusters(rows: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per vector that counts: its id, ``cluster``, squared ``distance``, the sums of distances ``cluster_inertia`` and ``inertia``,
    and ``centroid_sha256`` of its centroid's components in decimal, joined by commas."""
    frame = packed(rows, dims, id_col, vector_col)
    blocks = frame.rdd
    centroids = starting(blocks, k, seed, dims)
    n = len(centroids)

    def passed(at: np.ndarray, distances: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Sums of each centroid's vectors (or of their distances) and their counts, over all blocks."""

        def one(state: tuple, block: Row) -> tuple:
            x = unpack(block.kind, block.data, dims)
            own, far = nearest(x, at)
            return added(state[0], gathered(far[:, None] if distances else x, own, n)), state[1] + np.bincount(own, minlength=n)

        zero = np.zeros((n, 1 if distances else dims), np.int64), np.zeros(n, np.int64)
        return blocks.treeAggregate(zero, one, lambda a, b: (added(a[0], b[0]), a[1] + b[1]))

    for _ in range(rounds if n else 0):
        centroids = moved(centroids, *passed(centroids))
    inertia = [int(v) for v in passed(centroids, distances=True)[0][:, 0]] if n else []
    shas = [hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest() for c in centroids]
    capped = np.array([min(v, LONGEST) for v in inertia], np.int64)
    total = min(sum(inertia), LONGEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                own, far = nearest(unpack(r["kind"], r["data"], dims), centroids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.frombuffer(r["ids"], "<i8"), mask=~np.frombuffer(r["known"], bool)),
                        pa.array(own.astype(np.int32)),
                        pa.array([min(v, LONGEST) for v in far.tolist()], pa.int64()),
                        pa.array(capped[own]),
                        pa.array(np.full(len(own), total)),
                        pa.array(shas).take(pa.array(own)),
                    ],
                    [id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return frame.mapInArrow(run, f"`{id_col}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
