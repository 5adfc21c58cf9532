"""Fill-in-middle: texts cut at two token borders and put in another order, by big-integer bit operations.

A token is a run of other characters with the white space before it, or the white space at the end. One ``bytes.translate`` makes a
class mask of a text's UTF-8 bytes, read as one big integer with a bit a byte; a shifted boolean operation marks the last byte of every
token, ``bit_count`` gives their number, and the byte behind the k-th token is found by halving the mask again and again, going on in the
half that holds the k-th set bit. White space is ASCII and no part of a longer code point, so cuts never split one.

Defined cases: a null text is empty; an empty text and one that contains a sentinel stay plain; a null doc_id hashes as an empty one; repeated
rows are answered each on their own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: "1" for bytes of a token's own characters, "0" for white space.
_CLASS = bytes(48 if b == 32 or 9 <= b <= 13 else 49 for b in range(256))


def ends(data: bytes) -> int:
    """A bit for each byte, bit 0 the first; set where a token ends."""
    if not data:
        return 0
    own = int(data.translate(_CLASS)[::-1], 2)
    last = 1 << len(data) - 1
    # A token ends where no byte of its kind follows; white space at the end is a token of its own.
    return own & ~(own >> 1) | (last & ~own)


def select(mask: int, k: int) -> int:
    """Place of the k-th set bit (from 1), by halves; there must be as many."""
    at, width = 0, mask.bit_length()
    while width > 1:
        half = width >> 1
        low = mask & ((1 << half) - 1)
        n = low.bit_count()
        if k <= n:
            mask, width = low, half
        else:
            mask, width, at, k = mask >> half, width - half, at + half, k - n
    return at


def draws(doc_id: int | None, seed: int) -> list[int]:
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]


def transformed(doc_id: int | None, data: bytes, seed: int = 42, rate: int = 50, spm_rate: int = 80) -> tuple[int, str, bytes, bytes | None, bytes | None]:
    """(n, form, output, prefix, middle); the last two are None for a plain text. Rates are in percent."""
    mask = ends(data)
    n = mask.bit_count()
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not data or h3 % 100 >= rate or any(s in data for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", data, None, None
    i, j = (select(mask, k) + 1 if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = data[:i], data[i:j], data[j:]
    if h4 % 100 < spm_rate:
        return n, "spm", SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle, prefix, middle
    return n, "psm", PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle, prefix, middle


def restored(output: bytes, form: str) -> bytes:
    """The text of an output; its parts hold no sentinel, and no sentinel's end begins another, so the first of each is the border."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    if not output.startswith(first):
        raise ValueError(f"not of form {form}")
    a, _, rest = output[len(first) :].partition(second)
    b, mark, middle = rest.partition(MIDDLE)
    if not mark:
        raise ValueError(f"not of form {form}")
    prefix, suffix = (b, a) if form == "spm" else (a, b)
    return prefix + middle + suffix


def reordered(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n, form, prefix_chars, middle_chars, output, restored) of any table of texts; one scan, no shuffle."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string()), ("restored", pa.string())])
    size = lambda part: None if part is None else len(part.decode("utf-8", "surrogatepass"))

    def rows(ids: list, texts: list[str]) -> Iterator[dict]:
        for doc_id, text in zip(ids, texts, strict=True):
            n, form, output, prefix, middle = transformed(doc_id, text.encode("utf-8", "surrogatepass"), seed, rate, spm_rate)
            yield {"id": doc_id, "n": n, "form": form, "prefix_chars": size(prefix), "middle_chars": size(middle), "output": output.decode("utf-8", "surrogatepass"), "restored": restored(output, form).decode("utf-8", "surrogatepass")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.release()
        for b in batches:
            ids, texts = b.column(0).to_pylist(), C.texts_of(b.column(1))
            for i, j in C.grouped(texts):
                yield pa.RecordBatch.from_pylist(list(rows(ids[i:j], texts[i:j])), schema)

    listed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return listed.mapInArrow(run, "id long, n long, form string, prefix_chars long, middle_chars long, output string, restored string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame) -> DataFrame:
    """Per document n, form, sizes, and the digests of its output and of the text rebuilt from that."""
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return reordered(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output").alias("output_sha256"), sha("restored").alias("restored_sha256"))
