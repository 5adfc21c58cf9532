"""WARC archives: one gzip member for each record, read back as a stream.

``write`` makes a response record for each distinct payload (that of the largest
page_id) and a revisit record for each further page with an equal payload; files
are written by the tasks into the shared folder under their final name only when
whole. ``read`` goes through a file once: it inflates member after member in small
pieces, takes as many payload bytes as Content-Length says, and checks the digests.

Defined cases: a null html is an empty payload; a null url becomes an empty
target; a null page_id is written as such and read back as null; repeated rows make a
record each, and those that equal the response in page_id and url are responses too; an empty table gives no file and no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import files

PIECE = 1 << 16
#: The date of all records: archives are made from tables, which have none.
DATE = "2024-01-01T00:00:00Z"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, digest_ok boolean, payload binary"


def digest(payload: bytes) -> str:
    """Base32 SHA-1, as WARC writes it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str, kind: str, refers_to, payload: bytes, length: int, sha1: str) -> bytes:
    """One record as a gzip member. A revisit has no body; length and digest are those of the whole payload."""
    body = payload if kind == "response" else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Page-Id: {'' if page_id is None else page_id}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"WARC-Block-Digest: sha1:{digest(body)}",
        f"WARC-Payload-Length: {length}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page-Id: {'' if refers_to is None else refers_to}"]
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n") + z.compress(body + b"\r\n\r\n") + z.flush()


#: Bytes of a header, at most; it ends with an empty line.
HEAD = 1 << 16


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, body) of each gzip member of a stream of bytes; holds one record at a time.

    A header is inflated first, then as many bytes as its Content-Length says and the four that end a record; a member that holds more is refused before
    more is inflated. A member that breaks off at any byte, a missing Content-Length or a missing end raises ValueError.
    """
    data = next(pieces, b"")
    while data:
        inflate = zlib.decompressobj(31)

        def upto(out: bytearray, size: int, stop: bytes = b"") -> None:
            """Inflates until ``out`` has ``size`` bytes or holds ``stop``, or the member ends."""
            nonlocal data
            seen = max(0, len(out) - len(stop))
            while len(out) < size and not inflate.eof and not (stop and stop in out[seen:]):
                seen = max(0, len(out) - len(stop))
                if not data and not (data := next(pieces, b"")):
                    raise ValueError("the archive ends within a record")
                try:
                    out += inflate.decompress(data, min(PIECE, size - len(out)))
                except zlib.error as e:
                    raise ValueError("no gzip member") from e
                data = inflate.unused_data if inflate.eof else inflate.unconsumed_tail

        out = bytearray()
        upto(out, HEAD, b"\r\n\r\n")
        head, found, rest = bytes(out).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:] if ": " in x)
        if not found or not head.startswith(b"WARC/") or not fields.get("Content-Length", "").isdigit():
            raise ValueError("no WARC header")
        n, out = int(fields["Content-Length"]), bytearray(rest)
        upto(out, n + 5)
        if not inflate.eof or out[n:] != b"\r\n\r\n":
            raise ValueError("a record is longer or shorter than its Content-Length")
        yield fields, bytes(out[:n])
        data = data or next(pieces, b"")


def write(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes archives below ``folder`` and returns (path, n_records) of each; runs once, its result is checkpointed.

    Payloads of fewer than ``least_bytes`` are always responses.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("payload")).withColumn("_sha", F.unhex(F.sha1("payload")))
    # Each copy of a payload is the same bytes; only payloads that occur more than once get a row here.
    of = F.struct(F.col("page_id"), F.col("url"))
    many = C.saved(rows.where(F.octet_length("payload") >= least_bytes).groupBy("_sha").agg(F.max(of).alias("_best"), F.count("*").alias("_n")).where("_n > 1"))
    # Pages of a very common payload are dealt over several tasks, and so over several archives.
    joined = C.spread(rows, many.select("_sha", "_best"), "_sha", C.hot(many, "_sha", "_n"), ["page_id", "url"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, path = 0, f"{folder}/pages-{TaskContext.get().partitionId():05d}.warc.gz"
        first = next(batches, None)
        if first is None:
            return
        with files.written(path) as out:
            while first is not None:
                for r in first.to_pylist():
                    best = r["_best"]
                    response = best is None or (best["page_id"], best["url"]) == (r["page_id"], r["url"])
                    out.write(record(r["page_id"], r["url"], "response" if response else "revisit", None if response else best["page_id"], r["payload"], len(r["payload"]), base64.b32encode(r["_sha"]).decode()))
                    n += 1
                first = next(batches, None)
        yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n]}, pa.schema([("path", pa.string()), ("n_records", pa.int64())]))

    return C.saved(joined.select("page_id", "url", "payload", "_sha", "_best").mapInArrow(run, "path string, n_records long"))


def read(spark: SparkSession, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the archives of ``manifest`` (a column ``path``), a task for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                with files.stream(path) as f:
                    held, size = [], 0
                    for fields, body in records(iter(lambda f=f: f.read(PIECE), b"")):
                        number = lambda x: int(x) if x else None
                        held.append({
                            "page_id": number(fields["WARC-Page-Id"]), "url": fields.get("WARC-Target-URI", ""), "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To-Page-Id")),
                            "payload_bytes": int(fields["WARC-Payload-Length"]), "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
                            "digest_ok": digest(body) == fields["WARC-Block-Digest"].removeprefix("sha1:") and (fields["WARC-Type"] == "revisit" or (digest(body) == fields["WARC-Payload-Digest"].removeprefix("sha1:") and len(body) == int(fields["WARC-Payload-Length"]))),
                            "payload": body if payloads else None,
                        })
                        size += len(body) if payloads else 200
                        if size > C.GROUP_BYTES:
                            yield pa.RecordBatch.from_pylist(held, SCHEMA)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, SCHEMA)

    paths = manifest.select("path").repartition(max(1, manifest.count()))
    return paths.mapInArrow(run, RECORDS)


SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("digest_ok", pa.bool_()), ("payload", pa.binary())])


def archived(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages written to archives and read back, one row each; a digest that doesn't hold fails the job."""
    manifest = write(pages, C.shared_dir(spark, "warc"), least_bytes)
    ok = F.when(F.col("digest_ok"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a WARC digest does not hold")))
    return read(spark, manifest, payloads=False).select("page_id", "payload_bytes", ok.alias("payload_digest"), "record_type", "refers_to")
