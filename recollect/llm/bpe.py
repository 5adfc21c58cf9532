"""Byte-level BPE by a lazily determinised transducer, decoding by an incremental UTF-8 machine.

A rank file defines the merges. Two tokens may stand side by side in an encoding
exactly if no merge across their border comes before both are formed (``may_follow``);
a sequence all of whose neighbours may follow one another is the encoding of its
bytes, and every prefix of a text has exactly one such sequence. That gives a
nondeterministic transducer: read bytes along a trie of the tokens, and where a token
ends, start anew behind it if it may follow the token before. ``Transducer``
determinises it while reading: a state is the set of live walks, and each (state, byte)
step is computed once. Tokens that all live walks have behind them are emitted; what
waits for a decision is no longer than the longest token.

Defined cases: a null or empty text has no ids (and the digest of nothing); text is split
by the pattern first, each match on its own, and no string is special; an unpaired
surrogate can't occur in Spark strings; repeated rows and null ids are kept; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

NEVER = 1 << 40


class Merges:
    """The tokens of a rank file and which of them may stand side by side."""

    #: Pairs remembered.
    MOST = 400_000

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {r: t for t, r in ranks.items()}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._follows: dict[int, bool] = {}

    @classmethod
    def from_file(cls, path: str) -> Merges:
        with open(path, "rb") as f:
            return cls({base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())})

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge forms this one; None for a byte, or if no merges lead to it."""
        if token not in self._halves:
            whole = self.bytes[token]
            parts = [self.ranks[whole[i : i + 1]] for i in range(len(whole))]
            while len(parts) > 2:
                best = min((self.ranks.get(self.bytes[a] + self.bytes[b], NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if best[0] >= token:
                    break
                parts[best[1] : best[1] + 2] = [best[0]]
            self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._halves[token]

    def _spine(self, token: int, side: int, known: dict) -> list[tuple[int, int]]:
        """Tokens at the right (side 1) or left (0) end of ``token`` while it is formed, with the rank at which each gives way."""
        if token not in known:
            out, until, at = [], NEVER, token
            while True:
                out.append((at, until))
                if (h := self.halves(at)) is None:
                    break
                at, until = h[side], at
            known[token] = out
        return known[token]

    def reachable(self, token: int) -> bool:
        return len(self.bytes[token]) == 1 or self.halves(token) is not None

    def may_follow(self, a: int, b: int) -> bool:
        """Whether a then b is the encoding of their bytes."""
        known = self._follows.get(a << 20 | b)
        if known is None:
            if len(self._follows) > self.MOST:
                self._follows = {}
            known = self._follows[a << 20 | b] = self._no_merge_across(a, b)
        return known

    def _no_merge_across(self, a: int, b: int) -> bool:
        for x, x_until in self._spine(a, 1, self._right):
            for y, y_until in self._spine(b, 0, self._left):
                # x and y stand side by side from when the later one is formed until the first gives way.
                # Of equal ranks the merge further left comes first.
                if x < y_until and y < x_until:
                    m = self.ranks.get(self.bytes[x] + self.bytes[y])
                    if m is not None and m < x_until and m <= y_until:
                        return False
        return True


class Transducer:
    """Reads bytes, emits ids.

    A state is the set of live (trie node, token that ends where the node's walk began) pairs; it has a number,
    and ``moves[state][byte]`` is (next state, token that ends behind this byte), computed when first taken.
    Each prefix of a text has one encoding, so each byte has one such token, and the tokens
    behind all live walks are settled: they are emitted at the latest after ``WINDOW`` bytes.
    """

    #: Bytes after which settled tokens are emitted; what stays is no longer than the longest token.
    WINDOW = 512

    def __init__(self, merges: Merges, most: int = 300_000):
        self.merges, self.most = merges, most
        self.next: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        self.depth: list[int] = [0]
        for token, rank in merges.ranks.items():
            if merges.reachable(rank):
                node = 0
                for byte in token:
                    if byte not in self.next[node]:
                        self.next[node][byte] = len(self.next)
                        self.next.append({})
                        self.token_at.append(-1)
                        self.depth.append(self.depth[node] + 1)
                    node = self.next[node][byte]
                self.token_at[node] = rank
        self.size = {rank: len(token) for token, rank in merges.ranks.items()}
        self._forget()

    def _forget(self) -> None:
        # A state's pairs as one number each: the node, and in the low 20 bits the token before, plus 1.
        first = (0,)
        self.states: list[tuple[int, ...]] = [first]
        self.number: dict[tuple[int, ...], int] = {first: 0}
        self.moves: dict[int, int] = {}

    def _move(self, state: int, byte: int) -> int:
        """Determinises one step: the next state's number, and in the low 20 bits the token that ends here."""
        out, ended = [], -1
        for pair in self.states[state]:
            node = self.next[pair >> 20].get(byte)
            if node is None:
                continue
            token, before = self.token_at[node], (pair & 0xFFFFF) - 1
            if token >= 0 and ended < 0 and (before < 0 or self.merges.may_follow(before, token)):
                ended = token
            if self.next[node]:
                out.append(node << 20 | before + 1)
        live = (*out, ended + 1)
        to = self.number.get(live)
        if to is None:
            to = self.number[live] = len(self.states)
            self.states.append(live)
        move = self.moves[state << 8 | byte] = to << 20 | ended
        return move

    def _traced(self, ends: list[int], at: int) -> list[int]:
        """The tokens up to position ``at``, from the token that ends at each position."""
        ids = []
        while at > 0:
            ids.append(ends[at])
            at -= self.size[ends[at]]
        ids.reverse()
        return ids

    def encode(self, piece: bytes) -> list[int]:
        whole = self.merges.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > self.most:
            self._forget()
        ids: list[int] = []
        ends, state, moves = [-1], 0, self.moves
        for byte in piece:
            move = moves.get(state << 8 | byte)
            if move is None:
                move = self._move(state, byte)
            state = move >> 20
            ends.append(move & 0xFFFFF)
            if len(ends) > self.WINDOW:
                ids += (done := self._settled(ends, state))
                del ends[1 : 1 + sum(map(self.size.__getitem__, done))]
        return ids + self._traced(ends, len(ends) - 1)

    def _settled(self, ends: list[int], state: int) -> list[int]:
        """The tokens that all live walks have behind them."""
        chains = [self._traced(ends, len(ends) - 1 - self.depth[pair >> 20]) for pair in self.states[state]]
        least = min(map(len, chains))
        same = next((k for k in range(least) if any(c[k] != chains[0][k] for c in chains)), least)
        return chains[0][:same]


def _utf8_steps() -> list[bytes]:
    """The machine's steps: for each state and byte the next state. Between code points it is in state 0; ``_NONE`` is no step.

    States 1, 2 and 3 wait for so many bytes of any kind that may follow; 4 to 7 come behind the first bytes
    after which the next byte is limited: E0 (no shorter form), ED (no surrogates), F0 (no shorter form) and F4 (no more than U+10FFFF).
    """
    steps = [bytearray([_NONE]) * 256 for _ in range(8)]
    for state, low, high, to in ((1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2)):
        steps[state][low : high + 1] = bytes([to]) * (high + 1 - low)
    for low, high, to in ((0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)):
        steps[0][low : high + 1] = bytes([to]) * (high + 1 - low)
    return [bytes(x) for x in steps]


_NONE = 8
_STEPS = _utf8_steps()


class Utf8:
    """UTF-8 read byte by byte: a code point comes out with its last byte, what is unfinished is kept as the state.

    Bytes that can't be part of UTF-8 become U+FFFD, one for each longest beginning of a code point, as ``errors="replace"`` has it.
    """

    def __init__(self):
        self.state = self.code = 0

    def feed(self, data: bytes, last: bool = False) -> str:
        out, state, code = [], self.state, self.code
        for byte in data:
            to = _STEPS[state][byte]
            if to == _NONE:
                out.append("\ufffd")
                if state == 0:
                    continue
                state, to = 0, _STEPS[0][byte]
                if to == _NONE:
                    out.append("\ufffd")
                    continue
            if state:
                code = code << 6 | byte & 0x3F
            else:
                code = byte if byte < 0x80 else byte & (0x1F if byte < 0xE0 else 0x0F if byte < 0xF0 else 0x07)
            state = to
            if state == 0:
                out.append(chr(code))
        if last and state:
            out.append("\ufffd")
            state = 0
        self.state, self.code = state, code
        return "".join(out)


class Codec:
    """Texts to ids and back. Units between single spaces are remembered: ``most`` that came last, and the ``most`` before."""

    def __init__(self, path: str, pattern: str, most: int = 200_000):
        self.merges = Merges.from_file(path)
        self.transducer = Transducer(self.merges)
        self.match = regex.compile(pattern).findall
        self.most = most
        self.units: dict[str, bytes] = {}  # by the text behind the space
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.spoken = [str(i) for i in range(max(self.merges.bytes) + 1)]
        self.bytes = [self.merges.bytes.get(i, b"") for i in range(max(self.merges.bytes) + 1)]
        # The text of each token that begins and ends between code points; other tokens take the machine byte by byte.
        self.whole = [_text_of(x) for x in self.bytes]

    def _unit(self, unit: str) -> bytes:
        ids: list[bytes] = []
        for piece in self.match(unit):
            got = self.pieces.get(piece)
            if got is None:
                got = self.pieces[piece] = np.array(self.transducer.encode(piece.encode("utf-8", "surrogatepass")), "<u4").tobytes()
            ids.append(got)
        return b"".join(ids)

    def encode(self, text: str) -> np.ndarray:
        """Ids of one text, each match of the pattern separately.

        A single space between other characters always begins a match, so units between
        such spaces are matched by themselves; any other text is matched as a whole.
        """
        if not text:
            return np.empty(0, "<u4")
        if "  " in text or "\n " in text or " \n" in text or text[0] == " " or text[-1] == " " or not text.replace("\n", "").isprintable():
            return np.frombuffer(self._unit(text), "<u4")
        first, *others = text.split(" ")
        parts = list(map(self.units.get, others))
        if None in parts:
            for u in {u for u, p in zip(others, parts, strict=True) if p is None}:
                self.units[u] = self.older[u] if u in self.older else self._unit(" " + u)
            parts = map(self.units.__getitem__, others)
        out = np.frombuffer(b"".join([self._unit(first), *parts]), "<u4")
        if len(self.units) > self.most:
            self.units, self.older = {}, self.units
        if len(self.pieces) > self.most * 3 // 4:
            self.pieces = {}
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode_stream(self, parts: Iterable[Iterable[int]]) -> Iterator[str]:
        """Text of ids that come in parts; a code point cut by a token's or a part's end comes with the next."""
        machine, whole = Utf8(), self.whole
        for ids in parts:
            texts = [whole[i] for i in ids]
            if machine.state or None in texts:
                texts = [t if t is not None and not machine.state else machine.feed(self.bytes[i]) for t, i in zip(texts, ids, strict=True)]
            if text := "".join(texts):
                yield text
        if text := machine.feed(b"", last=True):
            yield text


def _text_of(token: bytes) -> str | None:
    try:
        return token.decode()
    except UnicodeDecodeError:
        return None


def codec(path: str, pattern: str) -> Codec:
    """One for each worker process."""
    return C.hold(("bpe", path, pattern), lambda: Codec(path, pattern))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids array) of any table of texts; one scan, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            texts = C.texts_of(b.column(1))
            for i, j in C.grouped(texts):
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array([c.encode(t).tolist() for t in texts[i:j]], pa.list_(pa.int32()))], ["id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string")).mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode(coded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids", part: int = 4096) -> DataFrame:
    """Rows (id, text) from ids, read as a stream in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            texts = ["".join(c.decode_stream(ids[k : k + part] for k in range(0, len(ids), part))) for ids in (x or [] for x in b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return coded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>")).mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, pattern: str, with_text: bool = False, part: int = 65_536) -> DataFrame:
    """Per document n_tokens, ids_sha256 and decoded_sha256; ``with_text``: the decoded text as well. Ids are decoded as a stream, in parts."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", text string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            texts = C.texts_of(b.column(1))
            for i, j in C.grouped(texts):
                n, spoken, back, out = [], [], [], []
                for t in texts[i:j]:
                    ids = c.encode(t).tolist()
                    n.append(len(ids))
                    spoken.append(hashlib.sha256(",".join(map(c.spoken.__getitem__, ids)).encode()).hexdigest())
                    digest, read = hashlib.sha256(), []
                    for text in c.decode_stream(ids[k : k + part] for k in range(0, len(ids), part)):
                        digest.update(text.encode())
                        if with_text:
                            read.append(text)
                    back.append(digest.hexdigest())
                    if with_text:
                        out.append("".join(read))
                arrays = [b.column(0)[i:j], pa.array(n, pa.int64()), pa.array(spoken, pa.string()), pa.array(back, pa.string()), *([pa.array(out, pa.string())] if with_text else [])]
                yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
