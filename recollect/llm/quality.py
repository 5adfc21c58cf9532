"""Quality classifier: a ridge fit on random Fourier features of document statistics, calibrated by isotonic regression.

``features`` turns a whole text into a few statistics (shares of kinds of characters,
repetition of words and lines, lengths); labels, language, source and ids are never among
them. Random cosines of the standardised statistics approximate a Gaussian kernel; each
partition sums its part of the normal equations, the sums give the ridge weights. Raw
scores of rows left out of that fit are binned, and pool-adjacent-violators over the bins
maps scores to probabilities.

The fit takes at most ``MOST_LABELLED`` labelled rows (those with the least hash of their
id); scores are given to all rows.

Defined cases: a null text counts as empty and is scored like any other; labels that are
null, of unknown ids or of held-out rows are not learnt from, repeated labels of an id count
once (the largest); null ids are scored and count as not held out; without labels of both
kinds every score is the share of label 1 (1 if there are none at all); an empty table
gives no rows; further columns are ignored by ``scored`` and kept by ``kept``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

MOST_LABELLED = 20_000
N_FOURIER = 256
RIDGE = 1e-3
BINS = 200
THRESHOLD = 0.3

NAMES = ["upper", "digit", "bar", "bang", "symbol", "stop", "space", "other", "word_length", "long_words", "types", "same_as_last", "two_back", "line_words", "same_lines", "log_words", "word_variance", "top_symbol"]


def features(texts: list[str]) -> np.ndarray:
    """A row of statistics for each text, all bounded."""
    out = np.zeros((len(texts), len(NAMES)))
    for i, j in C.grouped(texts):
        words, first, starts, ends = C.word_hashes(texts[i:j])
        size = (ends - starts).astype(np.float64)
        same = np.zeros(len(words) + 1, bool)
        same[1:-1] = words[1:] == words[:-1] if len(words) else False
        two = np.zeros(len(words) + 1, bool)
        if len(words) > 2:
            two[2:-1] = words[2:] == words[:-2]
        for k in range(i, j):
            data = np.frombuffer(texts[k].encode("utf-8", "surrogatepass"), np.uint8)
            a, b = first[k - i], first[k - i + 1]
            if b == a:
                continue
            count = np.bincount(data, minlength=256).astype(np.float64)
            n, w = len(data), b - a
            symbols = count[[35, 36, 37, 38, 42, 64, 94, 95, 126]]
            lines = texts[k].split("\n")
            length = size[a:b]
            out[k] = (
                (count[65:91].sum() / n), count[48:58].sum() / n, count[124] / w, count[33] / w, symbols.sum() / w, (count[44] + count[46]) / w, count[[9, 10, 32]].sum() / n, count[128:].sum() / n,
                min(length.mean(), 40) / 10, (length > 15).mean(), len(np.unique(words[a:b])) / w, same[a + 1 : b].mean() if w > 1 else 0.0, two[a + 2 : b].mean() if w > 2 else 0.0,
                np.log1p(w / len(lines)) / 5, 1 - len(set(lines)) / len(lines), np.log1p(w) / 8, min(length.std(), 30) / 10, symbols.max() / w,
            )
    return np.sqrt(np.clip(out, 0, 4))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None
    #: Raw scores and the calibrated values at them, both ascending; between them values are interpolated.
    at: np.ndarray
    value: np.ndarray

    def fourier(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases)), z, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.weights if self.weights is not None else np.zeros(len(x))

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.at, self.value), 0.0, 1.0)


def fold(key: Column) -> Column:
    """crc32 of the id as text, modulo 5: 0 is held out."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5))


def isotonic(total: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing shares that fit good / total best, one for each bin."""
    pools: list[list[float]] = []
    for n, g in zip(total, good, strict=True):
        pools.append([n, g, 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            n2, g2, k2 = pools.pop()
            pools[-1] = [pools[-1][0] + n2, pools[-1][1] + g2, pools[-1][2] + k2]
    return np.concatenate([np.full(int(k), g / n) for n, g, k in pools])


def _summed(rows: DataFrame, part) -> np.ndarray | None:
    """Sum over the partitions of part(x, y, fold), an array of fixed size; rows are (x, y, fold)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.release()
        total = None
        for b in batches:
            if b.num_rows:
                x = np.array(b.column(0).to_pylist(), np.float64)
                got = part(x, b.column(1).to_numpy(zero_copy_only=False).astype(np.float64), b.column(2).to_numpy(zero_copy_only=False))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": [total.ravel().tolist()]}, pa.schema([("part", pa.list_(pa.float64()))]))

    parts = [np.array(r.part) for r in rows.mapInArrow(run, "part array<double>").toLocalIterator()]  # a few partitions, see fit
    return np.sum(parts, axis=0) if parts else None


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, seed: int = 11) -> Model:
    """The classifier from the labels of all folds but 0. Fold 1 is for calibration, the others are for the ridge fit."""
    key = F.col("doc_id").cast("long")
    known = labels.select(key.alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").where(fold(F.col("doc_id")) != 0)
    chosen = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(key.alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # at most ``most`` pairs of numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.release()
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(features(C.texts_of(b.column(0))).tolist(), pa.list_(pa.float64())), b.column(1), b.column(2)], ["x", "y", "fold"])

    rows = C.saved(texts.select("text", "quality", fold(F.col("doc_id")).cast("int").alias("fold")).mapInArrow(run, "x array<double>, y int, fold int").repartition(8))  # at most ``most`` rows; the scan before it keeps its width
    d = len(NAMES)
    sums = _summed(rows, lambda x, y, f: np.concatenate([[len(x), y.sum()], x.sum(axis=0), (x * x).sum(axis=0)]))
    rng = np.random.default_rng(seed)
    directions, phases = rng.normal(0, 1 / np.sqrt(d), (d, N_FOURIER)), rng.uniform(0, 2 * np.pi, N_FOURIER)
    if sums is None or sums[1] in (0, sums[0]):
        share = 1.0 if sums is None else sums[1] / sums[0]
        return Model(np.zeros(d), np.ones(d), directions, phases, None, np.zeros(1), np.array([share]))
    mean = sums[2 : 2 + d] / sums[0]
    scale = np.sqrt(np.maximum(sums[2 + d :] / sums[0] - mean**2, 1e-6))
    m = Model(mean, scale, directions, phases, None, np.zeros(1), np.zeros(1))
    # The rarer label weighs as much as the other, so that the raw score separates both.
    weight = {0.0: sums[0] / (2 * (sums[0] - sums[1])), 1.0: sums[0] / (2 * sums[1])}
    # (z, y) of the rows that ``keep`` chooses: X'WX and X'Wy side by side.
    equations = lambda keep: (lambda x, y, f: (z := m.fourier(x[keep(f)])).T @ (np.hstack([z, y[keep(f)][:, None]]) * np.where(y[keep(f)], weight[1.0], weight[0.0])[:, None]))

    def solved(got: np.ndarray) -> np.ndarray:
        size = N_FOURIER + d + 1
        a = got.reshape(size, size + 1)
        return np.linalg.solve(a[:, :size] + RIDGE * sums[0] * np.eye(size) / size, a[:, size])

    rest = _summed(rows, equations(lambda f: f != 1))
    m.weights = solved(rest if rest is not None and rest.any() else _summed(rows, equations(lambda f: f >= 0)))
    edges = np.linspace(-0.5, 1.5, BINS + 1)

    def binned(x: np.ndarray, y: np.ndarray, f: np.ndarray) -> np.ndarray:
        at = np.clip(np.searchsorted(edges, m.raw(x)) - 1, 0, BINS - 1)
        out = np.zeros((2, 2, BINS))
        for c in (0, 1):
            use = (f == 1) == bool(c)
            out[c] = np.bincount(at[use], minlength=BINS), np.bincount(at[use], y[use], minlength=BINS)
        return out

    out = _summed(rows, binned).reshape(2, 2, BINS)
    total, good = out[1] if out[1][0].sum() >= 50 else out.sum(axis=0)
    full = np.flatnonzero(total)
    m.at, m.value = (edges[:-1] + edges[1:])[full] / 2, isotonic(total[full], good[full])
    return m


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; one scan, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.release()
        for b in batches:
            score = model.score(features(C.texts_of(b.column(2))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    key = F.col("doc_id").cast("long")
    return docs.select(key.alias("doc_id"), F.coalesce(fold(key) == 0, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def kept(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that the classifier does not reject."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.release()
        for b in batches:
            yield b.filter(pa.array(model.score(features(C.texts_of(b.column(at)))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
