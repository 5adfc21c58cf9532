"""Token files with random access: ids in directly addressable codes.

An id is cut into ``CHUNK`` bit pieces, low piece first. Level k of a file holds
piece k of every id that has more than k pieces, and a bitmap that says which of
them go on at level k + 1; a rank directory (ones before every 512th bit) tells where
on the next level. Any token is so found by one look at each level, with nothing
unpacked before it. A file holds a contiguous range of documents by doc_id.

Layout: magic, length of a JSON header, the header (counts, and offset and length of
each part), then the parts: doc ids (int64), first token of each document (uint64, one more
entry than documents), and for each level pieces, bitmap and directory.

Defined cases: a null text is empty (its document has the end id alone); a null doc_id
sorts first and is read back as null; repeated ids are kept, in the order of their texts;
an empty table gives no file and no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import files

MAGIC = b"DACTOK1\n"
CHUNK = 8
BLOCK = 512
NO_ID = -(1 << 63)


def pack(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pieces, bitmap, rank directory) of each level."""
    levels, rest = [], ids.astype(np.uint64)
    while len(rest):
        more = rest >> np.uint64(CHUNK)
        on = more > 0
        ones = np.zeros(-(-len(on) // BLOCK) * BLOCK, bool)
        ones[: len(on)] = on
        rank = np.concatenate([[0], np.cumsum(ones.reshape(-1, BLOCK).sum(axis=1))]).astype(np.uint64)
        levels.append(((rest & np.uint64((1 << CHUNK) - 1)).astype(np.uint8), np.packbits(ones, bitorder="little"), rank))
        rest = more[on]
    return levels


def dump(doc_ids: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> list[bytes]:
    """The parts of a file."""
    parts = [doc_ids.astype("<i8").tobytes(), starts.astype("<u8").tobytes()]
    for pieces, bits, rank in (levels := pack(ids)):
        parts += [pieces.tobytes(), bits.tobytes(), rank.astype("<u8").tobytes()]
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    head = json.dumps({"documents": len(doc_ids), "tokens": len(ids), "levels": len(levels), "parts": [[int(a), len(p)] for a, p in zip(at, parts, strict=False)]}).encode()
    return [MAGIC, len(head).to_bytes(8, "little"), head, *parts]


class _Ranged:
    """An array in a file, of which only what is asked for is read."""

    def __init__(self, file, at: int, n: int, kind: str):
        self.file, self.at, self.n, self.kind = file, at, n, np.dtype(kind)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i):
        a, b, _ = i.indices(self.n) if isinstance(i, slice) else (int(i), int(i) + 1, 1)
        size = self.kind.itemsize
        got = np.frombuffer(self.file.read_at(max(0, b - a) * size, self.at + a * size), self.kind)
        return got if isinstance(i, slice) else got[0]


class TokenFile:
    """A file's bytes, or an open file, of which a look-up touches only what it needs."""

    def __init__(self, data):
        piece = (lambda n, at: data[at : at + n]) if isinstance(data, bytes) else data.read_at
        if piece(8, 0) != MAGIC:
            raise ValueError("not a token file")
        n = int.from_bytes(piece(8, 8), "little")
        self.head = json.loads(piece(n, 16))

        def part(i: int, kind: str):
            at, size = self.head["parts"][i]
            n_items = size // np.dtype(kind).itemsize
            return np.frombuffer(data, kind, n_items, 16 + n + at) if isinstance(data, bytes) else _Ranged(data, 16 + n + at, n_items, kind)

        self.doc_ids, self.starts = part(0, "<i8"), part(1, "<u8")
        self.levels = [(part(2 + 3 * k, "u1"), part(3 + 3 * k, "u1"), part(4 + 3 * k, "<u8")) for k in range(self.head["levels"])]

    def __len__(self) -> int:
        return self.head["tokens"]

    @staticmethod
    def _rank(bits: np.ndarray, rank: np.ndarray, i: int) -> int:
        """Ones before bit i: the directory's count and those within the block."""
        b = i // BLOCK
        return int(rank[b]) + int(np.unpackbits(bits[b * BLOCK // 8 : i // 8 + 1], bitorder="little")[: i - b * BLOCK].sum())

    def token(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        out = shift = 0
        for pieces, bits, rank in self.levels:
            out |= int(pieces[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i, shift = self._rank(bits, rank, i), shift + CHUNK
        return out

    def slice(self, i: int, j: int) -> np.ndarray:
        """Tokens i to j (j not included), read from their own pieces only."""
        j = min(j, len(self))
        out, at = np.zeros(max(0, j - i), np.uint32), None
        for k, (pieces, bits, rank) in enumerate(self.levels):
            if i >= j:
                break
            got = pieces[i:j].astype(np.uint32) << np.uint32(CHUNK * k)
            if at is None:
                out += got
            else:
                out[at] += got
            on = np.flatnonzero(np.unpackbits(bits[i >> 3 : (j + 7) >> 3], bitorder="little")[i & 7 : (i & 7) + j - i])
            at = on if at is None else at[on]
            i = self._rank(bits, rank, i)
            j = i + len(on)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.starts[k]), int(self.starts[k + 1]))


class Encoder:
    """Whole texts to ids by the tokenizers library, which sees each piece of text once while it is remembered.

    A piece is a run of letters, of marks or of digits between ASCII white space. Where a vocabulary's file has the form
    ``FORM``, the ids of a text are those of its pieces: the normaliser and the splitter join none of them. Runs in which that
    is not plain (an apostrophe, which may begin a contraction; control characters; characters beyond Latin letters, which may
    join their neighbours) are one piece each. With a file of any other form whole texts go to the library.

    Pieces are known by 64-bit hashes in an open table over numpy arrays; those of more than ``LONGEST`` bytes are not remembered.
    """

    #: What a vocabulary's file must say for pieces to be encoded by themselves.
    FORM = {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pattern": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
        "suffix": "</w>",
    }
    #: Pieces remembered by a worker; then it starts anew.
    MOST = 1 << 20
    LONGEST = 64

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, "rb") as f:
            said = json.load(f)
        splitters = (said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        form = {"normalizer": said.get("normalizer"), "pattern": (splitters[0].get("pattern") or {}).get("Regex"), "suffix": said["model"].get("end_of_word_suffix")}
        self.by_pieces = form == self.FORM and splitters[0].get("behavior") == "Removed" and splitters[0].get("invert") is True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.closing = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.closing[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        # A power of two, so that a step from slot to slot by a mask reaches them all.
        self.slots = np.full(1 << (4 * self.MOST - 1).bit_length(), -1, np.int32)
        self.hashes = np.zeros(1024, np.uint64)
        self.at = np.zeros(1024, np.int64)
        self.count = np.zeros(1024, np.int64)
        self.ids = np.zeros(4096, np.uint32)
        # The pieces' own bytes: a hash finds a row, the bytes say whether it is the piece's.
        self.place = np.zeros(1024, np.int64)
        self.size = np.zeros(1024, np.int64)
        self.bytes = np.zeros(1 << 16, np.uint8)
        # Rows that can be found by their hash; the others belong to one piece of one text.
        self.listed = np.zeros(1024, np.int64)
        self.n = self.n_ids = self.n_bytes = self.n_listed = 0

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if not self.by_pieces:
            return self._whole(texts)
        # Special tokens may hold white space and are matched before anything else.
        odd = [k for k, t in enumerate(texts) if any(s in t for s in self.special)]
        if odd:
            texts = list(texts)
            whole = dict(zip(odd, self._whole([texts[k] for k in odd]), strict=True))
            for k in odd:
                texts[k] = ""
        raw = b"\n".join(t.encode("utf-8", "surrogatepass") for t in texts) + b"\n"
        size = np.array([len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts], np.int64) + 1
        buf, starts, ends, kind = _pieces(raw)
        rows = self._rows(buf, starts, ends, kind)
        count = self.count[rows]
        behind = np.cumsum(count)
        ids = self.ids[np.repeat(self.at[rows] - (behind - count), count) + np.arange(behind[-1] if len(behind) else 0)]
        first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(size)]))
        cut = np.concatenate([[0], behind])[first].tolist()
        out = [ids[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        for k in odd:
            out[k] = whole[k]
        if self.n > self.MOST or self.n_bytes > self.LONGEST * self.MOST:
            self._forget()
        return out

    def _rows(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The table's row of each piece; new ones are learnt."""
        h = C.span_hashes(buf, starts, ends)
        rows = self._found(h)
        # Long pieces are looked up by nothing but their bytes: each gets a row of its own, which none finds again.
        long = ends - starts > self.LONGEST
        rows[long] = -1
        new = np.flatnonzero((rows < 0) & ~long)
        if len(new):
            _, which = np.unique(h[new], return_index=True)
            which = new[which]
            self._learn(buf, starts[which], ends[which], kind[which])
            self._remember(h[which])
            rows[new] = self._found(h[new])
        long |= self._others(buf, starts, ends, np.where(long, -1, rows))
        if long.any():
            at = np.flatnonzero(long)
            first = self.n
            self._learn(buf, starts[at], ends[at], np.full(len(at), _OPEN))
            rows[at] = np.arange(first, first + len(at))
            self._grow(self.n + len(at))
            self.n += len(at)
        return rows

    def _others(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Which pieces have a row (not -1) of another piece, whose hash is the same."""
        out = np.zeros(len(rows), bool)
        size = ends - starts
        out[(rows >= 0) & (self.size[rows] != size)] = True
        at = np.flatnonzero((rows >= 0) & ~out)
        size = size[at]
        if len(at):
            behind = np.cumsum(size)
            inner = np.arange(behind[-1]) - np.repeat(behind - size, size)
            differ = buf[np.repeat(starts[at], size) + inner] != self.bytes[np.repeat(self.place[rows[at]], size) + inner]
            out[at] = np.add.reduceat(differ, behind - size, dtype=np.int64) > 0
        return out

    def _found(self, h: np.ndarray) -> np.ndarray:
        mask = len(self.slots) - 1
        out = np.full(len(h), -1, np.int64)
        slot = (h >> np.uint64(40)).astype(np.int64) & mask
        row = self.slots[slot].astype(np.int64)
        open_ = np.flatnonzero(row >= 0)
        row, slot = row[open_], slot[open_]
        for _ in range(len(self.slots) + 1):
            if not len(open_):
                return out
            same = self.hashes[row] == h[open_]
            out[open_[same]] = row[same]
            other = np.flatnonzero(~same)
            open_, slot = open_[other], slot[other] + 1 & mask
            row = self.slots[slot].astype(np.int64)
            more = np.flatnonzero(row >= 0)
            open_, row, slot = open_[more], row[more], slot[more]
        raise RuntimeError("the table of pieces has no free slot")

    def _grow(self, n: int) -> None:
        if n > len(self.hashes):
            size = max(n, 2 * len(self.hashes))
            self.hashes, self.at, self.count, self.place, self.size = (np.resize(x, size) for x in (self.hashes, self.at, self.count, self.place, self.size))
        if len(self.slots) < 4 * n:
            self.slots = np.full(1 << (4 * n - 1).bit_length(), -1, np.int32)
            self._place(self.listed[: self.n_listed])

    def _remember(self, h: np.ndarray) -> None:
        """Gives the rows behind the last, which ``_learn`` has filled, their hashes (all different, none known)."""
        rows = np.arange(self.n, self.n + len(h))
        self._grow(self.n + len(h))
        self.hashes[rows] = h
        self.n += len(h)
        self._place(rows)
        if self.n_listed + len(rows) > len(self.listed):
            self.listed = np.resize(self.listed, max(self.n_listed + len(rows), 2 * len(self.listed)))
        self.listed[self.n_listed : self.n_listed + len(rows)] = rows
        self.n_listed += len(rows)

    def _place(self, rows: np.ndarray) -> None:
        mask = len(self.slots) - 1
        slot = (self.hashes[rows] >> np.uint64(40)).astype(np.int64) & mask
        for _ in range(len(self.slots) + 1):
            if not len(rows):
                return
            free = np.flatnonzero(self.slots[slot] < 0)
            self.slots[slot[free]] = rows[free]
            left = np.flatnonzero(self.slots[slot] != rows)
            rows, slot = rows[left], slot[left] + 1 & mask
        raise RuntimeError("the table of pieces has no free slot")

    def _learn(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: np.ndarray) -> None:
        """Ids of the pieces, put behind those of the rows so far."""
        data = buf.tobytes()
        listed = [data[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        n = len(listed)
        self._grow(self.n + n)
        size = ends - starts
        behind = self.n_bytes + np.cumsum(size)
        if n and behind[-1] > len(self.bytes):
            self.bytes = np.resize(self.bytes, max(int(behind[-1]), 2 * len(self.bytes)))
        self.place[self.n : self.n + n], self.size[self.n : self.n + n] = behind - size, size
        if n:
            self.bytes[self.n_bytes : behind[-1]] = buf[np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
            self.n_bytes = int(behind[-1])
        at, count = self.at[self.n : self.n + n], self.count[self.n : self.n + n]
        parts: list[np.ndarray] = []
        behind = self.n_ids
        # A run of letters or of marks is one word, whose last id alone ends a word: many go to the library as one text.
        plain, single = np.flatnonzero((kind == _LETTER) | (kind == _MARK)), [np.flatnonzero((kind != _LETTER) & (kind != _MARK))]
        for i in range(0, len(plain), 4096):
            part = plain[i : i + 4096]
            ids = np.array(self.tokenizer.encode(" ".join([listed[k] for k in part.tolist()]), add_special_tokens=False).ids, np.uint32)
            cut = np.flatnonzero(self.closing[ids]) + 1
            if len(cut) != len(part):
                single.append(part)
                continue
            count[part] = np.diff(cut, prepend=0)
            at[part] = behind + cut - count[part]
            parts.append(ids)
            behind += len(ids)
        rest = np.concatenate(single)
        for i in range(0, len(rest), 4096):
            part = rest[i : i + 4096]
            got = self._whole([listed[k] for k in part.tolist()])
            count[part] = [len(x) for x in got]
            at[part] = behind + np.cumsum(count[part]) - count[part]
            parts += got
            behind += int(count[part].sum())
        if behind > len(self.ids):
            self.ids = np.resize(self.ids, max(behind, 2 * len(self.ids)))
        self.ids[self.n_ids : behind] = np.concatenate(parts)
        self.n_ids = behind


_SPACE, _LETTER, _DIGIT, _MARK, _OPEN = range(5)


def _kinds() -> np.ndarray:
    """The kind of each byte: letters are those of ASCII and the two-byte ones from U+00C0 to U+017F."""
    out = np.full(256, _OPEN, np.uint8)
    out[33:127] = _MARK
    out[[9, 10, 13, 32]] = _SPACE
    out[48:58] = _DIGIT
    out[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = _LETTER
    out[39] = _OPEN
    return out


_KIND = _kinds()


def _pieces(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, and first byte, byte behind the last and kind of each piece; runs that stay whole are of kind _OPEN."""
    given, buf = np.frombuffer(raw, np.uint8), np.frombuffer(raw.lower(), np.uint8)
    kind = _KIND[buf]
    # Of the two-byte letters these are none, or become two characters in lower case.
    high = np.flatnonzero((buf == 0xC3) | (buf == 0xC4)) if not raw.isascii() else np.empty(0, np.int64)
    odd = high[((buf[high] == 0xC3) & ((buf[high + 1] == 0x97) | (buf[high + 1] == 0xB7))) | ((buf[high] == 0xC4) & (buf[high + 1] == 0xB0))]
    kind[odd] = _OPEN
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts = np.concatenate([[0], edge]) if len(kind) else edge
    ends = np.append(edge, len(kind)) if len(kind) else edge
    kinds = kind[starts]
    if (kinds == _OPEN).any():
        # A run between white space that holds an open byte is one piece.
        space = kinds == _SPACE
        run = np.cumsum(space)
        open_run = np.zeros(run[-1] + 1, bool)
        open_run[run[kinds == _OPEN]] = True
        inner = open_run[run] & ~space
        first = inner & ~np.concatenate([[False], inner[:-1] & (run[1:] == run[:-1])])
        last = inner & ~np.concatenate([inner[1:] & (run[1:] == run[:-1]), [False]])
        keep = ~inner & ~space
        whole = np.zeros(len(buf) + 1, np.int8)
        whole[starts[first]] += 1
        whole[ends[last]] -= 1
        buf = np.where(np.cumsum(whole[:-1]) > 0, given, buf)
        starts, ends, kinds = np.concatenate([starts[keep], starts[first]]), np.concatenate([ends[keep], ends[last]]), np.concatenate([kinds[keep], np.full(int(first.sum()), _OPEN, kinds.dtype)])
        order = np.argsort(starts, kind="stable")
        return buf, starts[order], ends[order], kinds[order]
    keep = kinds != _SPACE
    return buf, starts[keep], ends[keep], kinds[keep]


def encoder(path: str) -> Encoder:
    """One for each worker process; the library's own threads stay off, tasks are the unit of work."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return C.hold(("tokens", path), lambda: Encoder(path))


#: Ids of a file: a block of more is written in several files.
FILE_IDS = 1 << 24


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 1, rows_per_file: int = 4096, file_ids: int = FILE_IDS) -> DataFrame:
    """Token files of contiguous doc_id ranges below ``folder``; returns (block, part, path, n_docs, n_tokens), checkpointed.

    A file holds about ``rows_per_file`` documents and no more than ``file_ids`` ids, but for the last document's.
    """
    rows, _ = C.with_blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), rows_per_block=rows_per_file, most_blocks=1 << 17)
    dealt = rows.select("_block", "doc_id", "_key", "text").repartition("_block").sortWithinPartitions("_block", "_key", "text")
    end = np.array([end_id], np.uint32)
    schema = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def flush(block: int, part: int, ids: list, coded: list[np.ndarray]) -> pa.RecordBatch:
        path = f"{folder}/tokens-{block:06d}-{part:04d}.dac"
        starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in coded])])
        tokens = np.concatenate([x for y in coded for x in (y, end)])
        with files.written(path) as out:
            for piece in dump(np.array([NO_ID if x is None else x for x in ids], np.int64), starts, tokens):
                out.write(piece)
        return pa.RecordBatch.from_pylist([{"block": block, "part": part, "path": path, "n_docs": len(ids), "n_tokens": len(tokens)}], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, block, part, n, ids, coded = encoder(vocabulary), None, 0, 0, [], []
        for b in batches:
            texts = C.texts_of(b.column("text"))
            for i, j in C.grouped(texts):
                for at, doc_id, x in zip(b.column("_block")[i:j].to_pylist(), b.column("doc_id")[i:j].to_pylist(), encode(texts[i:j]), strict=True):
                    if at != block or n >= file_ids:
                        if ids:
                            yield flush(block, part, ids, coded)
                        part = part + 1 if at == block else 0
                        block, n, ids, coded = at, 0, [], []
                    ids.append(doc_id)
                    coded.append(x)
                    n += len(x) + 1
        if ids:
            yield flush(block, part, ids, coded)

    return C.saved(dealt.select("_block", "doc_id", "text").mapInArrow(run, "block long, part long, path string, n_docs long, n_tokens long"))


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32; a task for a few files."""
    n_files = max(1, manifest.count())

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = []
            for path in b.column("path").to_pylist():
                with files.ranged(path) as f:
                    n.append(len(TokenFile(f)))
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("part"), b.column("path"), pa.array(n, pa.int64())], ["block", "part", "path", "n"])

    # One row a file, from its header: the running sum goes over files, never over documents.
    counted = manifest.select("block", "part", "path").repartition(min(n_files, 64)).mapInArrow(heads, "block long, part long, path string, n long")
    placed = counted.selectExpr("path", "coalesce(sum(n) over (order by block, part rows between unbounded preceding and 1 preceding), 0) as base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                f = TokenFile(files.contents(path))
                starts = f.starts.astype(np.int64)
                ids = f.slice(0, len(f)).astype("<u4").tobytes() if len(f) <= 2 * FILE_IDS else None
                sums = [zlib.crc32(ids[4 * i : 4 * j] if ids is not None else f.slice(i, j).astype("<u4").tobytes()) for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(f.doc_ids, pa.int64(), mask=f.doc_ids == NO_ID), pa.array(starts[:-1] + base), pa.array(np.diff(starts)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    return placed.repartition(n_files).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def stored(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """Documents encoded, written and read back."""
    return read(spark, write(docs, C.shared_dir(spark, "tokens"), vocabulary, end_id))
