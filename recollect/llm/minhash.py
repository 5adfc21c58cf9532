"""Document fingerprints: MinHash over word shingles, near copies by banded signatures.

A fingerprint is the MinHash signature of a text's five-word shingles under
``PERMUTATIONS`` multiply-shift hash functions, 16 bits of each minimum, in
base64. Two fingerprints agree in about the Jaccard similarity of their texts'
shingle sets; equal texts always have equal fingerprints.

Defined cases: a null text counts as empty; texts without words share one
fingerprint (likeness 1 with each other); a text of fewer than five words has one
shingle of all of them; repeated rows and repeated ids are kept, each with its own
result; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import ngram_join

PERMUTATIONS = 128
#: 32 bands of 4: a pair at similarity 0.8 shares one with probability 1 - (1 - 0.8**4)**32, over 0.9999999.
BANDS = 32


def fingerprints(texts: list[str], permutations: int = PERMUTATIONS) -> np.ndarray:
    """Signatures of the texts, a row each."""
    perms = C.permutations(permutations)
    parts = [np.empty((0, permutations), np.uint16)]
    for i, j in C.grouped(texts):
        words, first, _, _ = C.word_hashes(texts[i:j])
        parts.append(C.signatures(*C.shingle_hashes(words, first), perms, bits=16))
    return np.concatenate(parts)


def encode(signature: np.ndarray) -> str:
    return base64.b64encode(signature.astype("<u2").tobytes()).decode()


def edited(text: str, following: str) -> str:
    """``text`` whose last quarter of code points gives way to the first as many of ``following`` (or all)."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fingerprint) of any table of texts; one scan, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.release()
        for b in batches:
            signs = fingerprints(C.texts_of(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encode(s) for s in signs], pa.string())], ["id", "fingerprint"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fingerprint string").withColumnRenamed("id", id_col)


def with_following(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and how alike these and the next document's are.

    The next document is the one with the next higher doc_id (null first; equal ids by
    text; after the last: the first). Texts cross one shuffle, into contiguous doc_id
    ranges; the first document of each range also goes to the range before it.
    """
    rows, n = C.with_blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    before = F.when(F.col("_first"), F.array(F.col("_block"), (F.col("_block") + n - 1) % n)).otherwise(F.array(F.col("_block")))
    dealt = rows.select("doc_id", "text", "_key", F.posexplode(before).alias("_guard", "_in")).repartition("_in").sortWithinPartitions("_in", "_guard", "_key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.release()
        held: list[tuple] = []  # rows not yet answered; the last has no next row so far
        block, open_block = None, False
        for b in batches:
            for i, j in C.grouped(ts := C.texts_of(b.column("text"))):
                rows = zip(b.column("doc_id")[i:j].to_pylist(), ts[i:j], b.column("_guard")[i:j].to_pylist(), b.column("_in")[i:j].to_pylist(), fingerprints(ts[i:j]), strict=True)
                for doc_id, text, guard, at, sign in rows:
                    if at != block:
                        block, open_block = at, True
                    if held and open_block and held[-1][3] is None and held[-1][4] == at:
                        held[-1] = (*held[-1][:3], (text, sign), at)
                    if guard:
                        open_block = False
                    else:
                        held.append((doc_id, text, sign, None, at))
                done, held = held[:-1], held[-1:]
                yield from answer(done)
        yield from answer(held)

    def answer(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not rows:
            return
        changed = [edited(r[1], r[3][0]) for r in rows]
        signs = fingerprints(changed)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([len(r[1]) for r in rows], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
                pa.array([encode(r[2]) for r in rows], pa.string()),
                pa.array([encode(s) for s in signs], pa.string()),
                pa.array([float(np.mean(r[2] == s)) for r, s in zip(rows, signs, strict=True)], pa.float64()),
                pa.array([float(np.mean(r[2] == r[3][1])) for r in rows], pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    return dealt.select("doc_id", "text", "_guard", "_in").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def near_classes(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """Near copies by signature bands: per document class_id, text_id, n_copies and n_links, as ``ngram_join.classes`` has them.

    Different texts whose signatures agree in a band share a bucket. Of a bucket all pairs are compared by
    signature, in tiles; what hangs together is verified by exact Jaccard over the shingle sets, pair by pair and in
    tiles too. Tiles return counts and spanning forests, so no pair is given out and no link is lost to a stand-in.
    """
    stand = ngram_join.stands(docs, C.permutations(PERMUTATIONS), bits=16)
    size = 2 * PERMUTATIONS // BANDS
    bucket = F.explode(F.array(*[F.xxhash64(F.lit(i), F.substring("sketch", 1 + i * size, size)) for i in range(BANDS)])).alias("bucket")
    bands = stand.where("sketch is not null").select("id", bucket)
    counted = C.saved(bands.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.min("id").alias("least"), F.max("id").alias("most")).where("n > 1"))
    once = counted.groupBy("n", "x", "least", "most").agg(F.min("bucket").alias("bucket")).select("bucket", "n")  # of buckets of the same texts, one
    near = C.spread(bands, once, "bucket", C.hot(counted, "bucket"), ["id"])
    return ngram_join.of_documents(docs, ngram_join.with_classes(docs, stand, near.select("id", "bucket", "n"), "<u2", least))
