"""Shared helpers of the training-data operators.

Words are what ``str.split()`` yields; a *shingle* is the hash of ``width``
consecutive words. A text with at least one but fewer than ``width`` words has
one shingle made of all its words, a text without words has none.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

SHINGLE_WORDS = 5
#: Texts are worked on in groups of about so many bytes, which bounds the arrays.
GROUP_BYTES = 1 << 20

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_MASK = (1 << 64) - 1
_powers: np.ndarray = np.ones(1, np.uint64)
_inverse: np.ndarray = np.ones(1, np.uint64)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder for one run below the folder that driver and executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. Where it is unset, a temporary folder serves
    if driver and executors are one process (local mode, as in tests); on a cluster that is an error.
    """
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint_root(spark: SparkSession) -> str:
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or _own_root.get(sc.applicationId)
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _own_root[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(root)
    return root


#: The folder that this process chose for an application whose settings name none.
_own_root: dict[str, str] = {}


def saved(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def narrow(schema: str) -> str:
    """A schema string on one line (they are written over several)."""
    return " ".join(schema.split())


_held: dict[tuple, object] = {}


def hold(key: tuple, make):
    """A worker's table, made once and kept for the tasks that follow; tables of other operators go."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Frees the worker's tables: Spark uses its Python workers again for other operators."""
    _held.clear()


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """The texts of an Arrow column; null counts as empty."""
    return [t or "" for t in column.to_pylist()]


def grouped(texts: list, most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of consecutive texts of about ``most`` characters together."""
    i = size = 0
    for j, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield i, j + 1
            i, size = j + 1, 0
    if i < len(texts):
        yield i, len(texts)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << max(21, (n - 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("_powers", _BASE), ("_inverse", inverse)):
            p = np.ones(1, np.uint64)
            while len(p) < size:
                p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
            globals()[name] = p


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: differences of one prefix polynomial modulo 2**64."""
    n = len(buf)
    _grow(n + 1)
    prefix = np.empty(n + 1, np.uint64)
    prefix[0] = 0
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _powers[:n], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * _inverse[starts] + (ends - starts).astype(np.uint64) * _MULT)


_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = False
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_hashes(texts: list[str], plain: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, with first word of each text (one more entry than texts), and byte spans.

    ``plain``: words are runs of letters and digits, in lower case. Otherwise
    they are what ``str.split()`` yields.
    """
    if plain:
        texts = [t.lower() for t in texts]
    # White space beyond ASCII becomes a plain space, so that bytes tell words apart.
    parts = [(t if t.isascii() or not _ODD_SPACE.search(t) else " ".join(t.split())).encode("utf-8", "surrogatepass") for t in texts]
    joined = b"\n".join(parts) + b"\n"
    buf = np.frombuffer(joined, np.uint8)
    inside = (_ALNUM if plain else _WORD)[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    first = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=first[1:])
    return span_hashes(buf, starts, ends), np.searchsorted(starts, first), starts, ends


#: White space beyond ASCII, as str.split() has it.
_ODD_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts one after the other, and where each text's begin (one more entry than texts)."""
    n = np.diff(first)
    odd = [np.uint64(pow(0xA24BAED4963EE407, k + 1, 1 << 64) | 1) for k in range(width)]
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    start = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=start[1:])
    if not start[-1]:
        return np.empty(0, np.uint64), start
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    at = np.repeat(first[:-1] - start[:-1], count) + np.arange(start[-1])
    out = np.zeros(len(at), np.uint64)
    last = np.repeat(first[1:], count)
    short = bool((n[n > 0] < width).any())
    for k in range(width):
        w = padded[at + k] * odd[k]
        out += np.where(at + k < last, w, np.uint64(0)) if short else w
    return mix(out), start


def permutations(k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of k multiply-shift hash functions (a universal family)."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 64, k, np.uint64) | np.uint64(1), rng.integers(0, 1 << 64, k, np.uint64)


def signatures(shingles: np.ndarray, start: np.ndarray, perms: tuple[np.ndarray, np.ndarray], bits: int = 32) -> np.ndarray:
    """MinHash signature of each text (a row of ``bits`` wide values); a text without shingles has all ones."""
    n = len(start) - 1
    kind = np.uint32 if bits > 16 else np.uint16
    out = np.full((n, len(perms[0])), (1 << bits) - 1, kind)
    full = np.flatnonzero(np.diff(start))
    if not len(full):
        return out
    at = start[full]
    buf = np.empty_like(shingles)
    low = np.uint64(64 - bits)
    for k, (a, b) in enumerate(zip(*perms, strict=True)):
        np.multiply(shingles, a, out=buf)
        buf += b
        least = np.minimum.reduceat(buf, at)
        # Low bits of the least value would be far from uniform; mix it, then cut.
        out[full, k] = (mix(least) >> low).astype(kind)
    return out


def with_blocks(df: DataFrame, by: str = "doc_id", rows_per_block: int = 512, most_blocks: int = 16384) -> tuple[DataFrame, int]:
    """``df`` with ``_key`` (``by``, null first) and ``_block``: contiguous ranges of ``by`` of about equal row counts.

    Only the blocks' first keys reach the driver: one for each block, and at most
    ``most_blocks`` (a matter of file and task sizes, not of results). They go back as one constant of the plan.
    """
    keyed = df.withColumn("_key", F.coalesce(F.col(by).cast("long"), F.lit(-(1 << 63))))
    n = keyed.select("_key").agg(F.count("*")).first()[0]
    want = min(most_blocks, max(1, -(-n // rows_per_block)))
    firsts: list[int] = []
    if n:
        cuts = keyed.agg(F.percentile_approx("_key", F.lit([i / want for i in range(want)]), F.lit(max(10000, 4 * want))).alias("q")).first()[0]
        rows = keyed.groupBy(block_of(F.col("_key"), sorted(set(cuts))).alias("b")).agg(F.min("_key").alias("k")).collect()
        firsts = sorted(r.k for r in rows)
    return keyed.withColumn("_first", first_of(F.col("_key"), firsts)).withColumn("_block", block_of(F.col("_key"), firsts)), max(1, len(firsts))


def _constant(numbers: list[int]) -> Column:
    """The numbers as an array, written as one text (folded into a constant when the plan is made) and not as a literal each."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def block_of(key: Column, firsts: list[int]) -> Column:
    """Index of the largest entry of the sorted list that is not above ``key`` (0 if none is): a binary search."""
    if len(firsts) < 2:
        return F.lit(0)
    steps = [1 << i for i in reversed(range((len(firsts) - 1).bit_length()))]
    array = _constant(firsts)
    return F.aggregate(F.lit(steps), F.lit(0), lambda lo, s: F.when(F.get(array, lo + s) <= key, lo + s).otherwise(lo))


def first_of(key: Column, firsts: list[int]) -> Column:
    return F.get(_constant(firsts), block_of(key, firsts)) == key if firsts else F.lit(False)


#: Keys that are dealt over ``SALTS`` tasks each: so many of those with most rows, if they have more than ``HOT_ROWS``.
HOT_KEYS = 1000
HOT_ROWS = 1000
SALTS = 32


def hot(counted: DataFrame, key: str, n: str = "n", above: int = HOT_ROWS) -> list:
    """The keys of most rows, ``HOT_KEYS`` at most; any other key has ``above`` rows or fewer, or less than 1 / ``HOT_KEYS`` of all."""
    return [r[0] for r in counted.where(F.col(n) > above).orderBy(F.desc(n), key).limit(HOT_KEYS).select(key).collect()]


def spread(rows: DataFrame, few: DataFrame, key: str, hot_keys: list, by: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``few``, which has one row a key. Rows of a hot key are dealt by their columns ``by``, each part with a copy of its row of ``few``.

    Without hot keys it is a plain join.
    """
    if not hot_keys:
        return rows.join(few, key, how)
    listed = F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in hot_keys], StructType([StructField(key, rows.schema[key].dataType)]))).withColumn("_hot", F.lit(True))  # HOT_KEYS at most
    dealt = rows.join(listed, key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_hot")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(few.join(listed, key, "left").withColumn("_salt", F.explode(salts)).drop("_hot"), [key, "_salt"], how).drop("_salt")


def in_place(rows: DataFrame, few: DataFrame, key: str, hot_keys: list) -> DataFrame:
    """``rows`` joined with ``few``, which has one row a key or none. Rows of a hot key stay where they are: ``few``'s rows of these keys,
    ``HOT_KEYS`` at most, go to them. Only the other rows are shuffled."""
    is_hot = F.col(key).isin(hot_keys)
    return rows.where(~is_hot).join(few.where(~is_hot), key).unionByName(rows.where(is_hot).join(F.broadcast(few.where(is_hot)), key))


#: Edges that a partition of a component search holds at least, if there are as many.
EDGES_A_PARTITION = 50_000


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """Connected components of (a, b) long pairs: rows (node, label), label the least node of its component.

    Alternates large-star and small-star steps as joins with a group minimum, so that no neighbourhood is ever
    held in memory; those of nodes with very many neighbours are dealt over several tasks. Each round is checkpointed.
    Nodes without an edge don't appear; an empty input gives no rows.
    """
    a, b = F.col("a"), F.col("b")
    e = saved(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct())
    seen = None
    for _ in range(most_rounds):
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == seen:
            break
        seen = now
        # Few edges in many partitions would be mostly files and tasks.
        e = e.coalesce(max(1, now[0] // EDGES_A_PARTITION))
        both = e.unionByName(e.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count_if(b > a).alias("n"))
        crowded = hot(least, "a") if now[0] > HOT_ROWS else []
        large = spread(both.where("b > a"), least.drop("n"), "a", crowded, ["b"]).select(b.alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = saved(large.coalesce(max(1, now[0] // EDGES_A_PARTITION)))
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        crowded = hot(least, "a") if now[0] > HOT_ROWS else []
        least = least.drop("n")
        small = spread(large, least, "a", crowded, ["b"])
        e = saved(small.select(b.alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.withColumnRenamed("m", "b")).distinct().coalesce(max(1, now[0] // EDGES_A_PARTITION)))
    else:
        raise RuntimeError("components did not settle")
    return e.select(a.alias("node"), b.alias("label")).unionByName(e.select(b.alias("node"), b.alias("label")).distinct())
