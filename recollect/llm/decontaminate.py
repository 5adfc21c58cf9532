"""Benchmark decontamination: edit distance by CGK embedding, repeated bit sampling, and exact verification.

The Chakraborty-Goldenberg-Koucky walk reads a word sequence with one pointer: at step j it
puts out the word under the pointer, and a random function of (j, word) decides whether the
pointer moves. Two sequences of small edit distance give outputs of small Hamming distance
under the same functions. ``WALKS`` walks are taken over windows of each item's size class;
of each output ``SAMPLES`` samples of ``BITS`` positions are hashed, and a window whose hash
equals that of an item is a candidate. Documents have a window every ``STRIDE`` words; an item has one at ``STRIDE`` offsets
next to one another, and so again after each half of a window's length up to its end. So of each stretch of the item some window of
a passage starts at the same word, and a long item is found by any of its stretches. From 39 words on a window has at most half of its item's words, so that some
window has few of the edits: after an edit a walk takes some steps to fall in with the other again, and whole items of a hundred words with a fifth of edits hardly agree anywhere.
Items too short for that have windows of ``SHORT`` words at every word, and so have documents, if there are such items.

What is found is what the samples find: 0.95 or more of the passages with a fifth of their words edited at every length measured (6 to 300 words), nearly all with a tenth, all with none.

Candidates are verified exactly: the least word edit distance between the item and any stretch
of the document around the window, at most ``MOST_EDITS`` of the item's words.

The benchmark is the query set: it is taken in blocks of at most ``BLOCK_CHARS`` characters and
``BLOCK_ITEMS`` items, each block's table goes to all tasks (a bounded broadcast), and each
block scans all documents once. Nothing is shuffled.

Words are runs of letters and digits in lower case. Defined cases: null texts count as empty;
items of fewer than ``LEAST_WORDS`` words are searched as they are, by all words in order
(no edits: an edit of so few words says nothing); items without words match nothing; null ids stay null and
repeated rows are kept on either side; empty tables give no matches; further columns are kept by ``clean``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

STRIDE = 8
WALKS = 6
SAMPLES = 8
BITS = 5
#: The same for the windows of short items, which stand at every word.
SHORT_WALKS, SHORT_SAMPLES, SHORT_BITS = 4, 4, 4
MOST_EDITS = 0.2
LEAST_WORDS = 6
#: Table cells of verification that are worked on together.
MOST_HITS = 1 << 20
#: Words of a window of short items, and in each size class; an item belongs to the largest that fits twice (the least: once) and leaves room for STRIDE offsets.
SHORT, CLASSES = 4, (8, 16, 32)
BLOCK_CHARS = 16_000_000
BLOCK_ITEMS = 20_000


def size_class(n_words: int) -> tuple[int, int]:
    """Words and stride of the windows of an item: the largest class of at most half its words less STRIDE - 1 (the least: of all); if there is none, SHORT at every word."""
    return max([(c, STRIDE) for c in CLASSES if (1 if c == CLASSES[0] else 2) * c + STRIDE - 1 <= n_words], default=(SHORT, 1))


class Walks:
    """The random functions and sampled positions of one class of windows."""

    def __init__(self, words: int, stride: int = STRIDE):
        rng = np.random.default_rng(1000 + words + 7 * (STRIDE - stride))
        self.words, self.steps, self.stride = words, 2 * words, stride
        self.n_walks, self.n_samples = (WALKS, SAMPLES) if stride > 1 else (SHORT_WALKS, SHORT_SAMPLES)
        bits = min(BITS if stride > 1 else SHORT_BITS, self.steps - 2)
        self.moves = rng.integers(0, 1 << 64, (self.n_walks, self.steps), np.uint64) | np.uint64(1)
        self.samples = [[np.sort(rng.choice(self.steps - 2, bits, replace=False)) for _ in range(self.n_samples)] for _ in range(self.n_walks)]
        self.odd = rng.integers(0, 1 << 64, (self.n_walks, self.n_samples, self.steps), np.uint64) | np.uint64(1)

    def buckets(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A row of hashes, one for each sample of each walk, for each window from ``starts`` on; past its end a text reads as zeros."""
        padded = np.concatenate([words, np.zeros(1, np.uint64)])
        out = np.zeros((len(starts), self.n_walks * self.n_samples), np.uint64)
        for w in range(self.n_walks):
            at = starts.copy()
            last = max(int(s[-1]) for s in self.samples[w])
            wanted = defaultdict(list)
            for s, positions in enumerate(self.samples[w]):
                for p in positions.tolist():
                    wanted[p].append(w * self.n_samples + s)
            for j in range(last + 1):
                word = padded[np.minimum(at, len(words))]
                word[at >= ends] = 0
                for s in wanted[j]:
                    out[:, s] += word * self.odd[w, s - w * self.n_samples, j]
                at += ((word * self.moves[w, j]) >> np.uint64(63)).astype(np.int64)
        for s in range(out.shape[1]):
            out[:, s] = C.mix(out[:, s] + np.uint64((s + 1) * 1_000_003 + self.words * 16 + self.stride))
        return out


def distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(least word edit distance between item and any stretch of text, end of that stretch)."""
    row = np.zeros(len(text) + 1, np.int64)
    steps = np.arange(len(text) + 1)
    for k, word in enumerate(item.tolist()):
        new = np.empty_like(row)
        new[0] = k + 1
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (text != word))
        # Words of the text left out: a running minimum along the row.
        row = np.minimum.accumulate(new - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


def distances(items: np.ndarray, texts: np.ndarray, inside: np.ndarray, most: int) -> np.ndarray:
    """``distance`` of each row's item and text, of which only the words ``inside`` count; more than ``most`` may come out as any larger number."""
    row = np.zeros((len(texts), texts.shape[1] + 1), np.int32)
    steps = np.arange(texts.shape[1] + 1, dtype=np.int32)
    new = np.empty_like(row)
    for k in range(items.shape[1]):
        new[:, 0] = k + 1
        np.minimum(row[:, 1:] + 1, row[:, :-1] + ((texts != items[:, k : k + 1]) | ~inside), out=new[:, 1:])
        row = np.minimum.accumulate(new - steps, axis=1) + steps
        if row.min() > most:
            break
    return row.min(axis=1)


class Benchmark:
    """A block of items, ready to be looked up."""

    def __init__(self, ids: list, texts: list[str]):
        words, first, _, _ = C.word_hashes(texts, plain=True)
        self.ids = ids
        self.items = [words[first[k] : first[k + 1]] for k in range(len(ids))]
        self.short = defaultdict(list)
        self.walks: dict[tuple[int, int], Walks] = {}
        found = defaultdict(list)
        for k, item in enumerate(self.items):
            if len(item) < LEAST_WORDS:
                if len(item):
                    self.short[int(item[0])].append(k)
                continue
            c, stride = size_class(len(item))
            walks = self.walks.setdefault((c, stride), Walks(c, stride))
            for shift in range(0, len(item) - c - stride + 2, c // 2 if stride > 1 else 1):
                for h in np.unique(walks.buckets(item, shift + np.arange(stride), np.full(stride, len(item)))).tolist():
                    found[h].append((k, shift))
        self.hashes = np.array(sorted(found), np.uint64)
        self.of = [found[h] for h in self.hashes.tolist()]
        self.first_words = np.array(sorted(self.short), np.uint64)
        # A bit table in front of the sorted hashes: most windows end here.
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self.hashes >> np.uint64(42)] = True
        self.lengths = np.diff(first)
        self.edits = (self.lengths * MOST_EDITS).astype(np.int64)

    def _candidates(self, words: np.ndarray, first: np.ndarray) -> set[tuple[int, int, int]]:
        """(text, item, word of the text at which the item would begin) triples."""
        out: set[tuple[int, int, int]] = set()
        n = np.diff(first)
        windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for stride in {walks.stride for walks in self.walks.values()}:
            per = -(-n // stride)
            text = np.repeat(np.arange(len(n)), per)
            starts = first[:-1][text] + stride * (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per))
            windows[stride] = text, starts, first[1:][text]
        for walks in self.walks.values():
            text, starts, ends = windows[walks.stride]
            got = walks.buckets(words, starts, ends)
            rows, columns = np.nonzero(self.bits[got >> np.uint64(42)])
            h = got[rows, columns]
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            for r, a in zip(rows[hit := self.hashes[at] == h].tolist(), at[hit].tolist(), strict=True):
                for k, shift in self.of[a]:
                    out.add((int(text[r]), k, int(starts[r]) - shift))
        return out

    def _verify(self, words: np.ndarray, first: np.ndarray, text: np.ndarray, item: np.ndarray, begin: np.ndarray, before: np.ndarray, more: np.ndarray, best: dict[tuple[int, int], tuple[int, int]]) -> None:
        """Puts the best match of each text and item into ``best``: where the item would begin at ``begin``, the text is looked at from
        ``before`` words before that on, over ``more`` words than the item has."""
        for n in np.unique(self.lengths[item]).tolist():
            these, e = np.flatnonzero(self.lengths[item] == n), int(n * MOST_EDITS)
            width = n + int(more[these[0]])
            step = max(1, MOST_HITS // width)
            for some in (these[x : x + step] for x in range(0, len(these), step)):
                t, k = text[some], item[some]
                at = (begin[some] - before[some])[:, None] + np.arange(width)
                inside = (at >= first[t][:, None]) & (at < first[t + 1][:, None])
                edits = distances(np.stack([self.items[x] for x in k.tolist()]), words[np.clip(at, 0, len(words) - 1)], inside, e)
                for x in np.flatnonzero(edits <= e).tolist():
                    pair, found = (int(t[x]), int(k[x])), (int(edits[x]), int(max(first[t[x]], begin[some[x]])))
                    if pair not in best or found < best[pair]:
                        best[pair] = found

    def matches(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """(text, item, edits, first word of the window) of the best match of each text and item."""
        words, first, _, _ = C.word_hashes(texts, plain=True)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        if self.walks and (found := self._candidates(words, first)):
            text, item, begin = np.array(sorted(found), np.int64).T
            self._verify(words, first, text, item, begin, self.edits[item] + STRIDE, 2 * (self.edits[item] + STRIDE), best)
        if len(self.first_words):
            for at in np.flatnonzero(np.isin(words, self.first_words)).tolist():
                t = int(np.searchsorted(first, at, "right")) - 1
                for k in self.short[int(words[at])]:
                    n = len(self.items[k])
                    if at + n <= first[t + 1] and (words[at : at + n] == self.items[k]).all():
                        best.setdefault((t, k), (0, at))
        return [(t, k, edits, at - int(first[t])) for (t, k), (edits, at) in best.items()]


def blocks(benchmark: DataFrame) -> Iterator[tuple[list, list[str]]]:
    """The benchmark in blocks of bounded size, by a hash of the item."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, -(-n // BLOCK_ITEMS), -(-int(size) // BLOCK_CHARS))
    for p in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).collect()
        if rows:
            yield [r.item_id for r in rows], [r.text for r in rows]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, word): items found in documents, the edits between them, and where."""
    schema = "doc_id long, item_id long, edits int, word int"
    out = docs.sparkSession.createDataFrame([], schema)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for ids, texts in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast((ids, texts))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            table = _table(shared)
            for b in batches:
                texts = C.texts_of(b.column(1))
                for i, j in C.grouped(texts):
                    if got := table.matches(texts[i:j]):
                        t, k, edits, word = zip(*got, strict=True)
                        yield pa.RecordBatch.from_arrays([b.column(0)[i:j].take(pa.array(t)), pa.array([table.ids[x] for x in k], pa.int64()), pa.array(edits, pa.int32()), pa.array(word, pa.int32())], ["doc_id", "item_id", "edits", "word"])

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out


def _table(shared) -> Benchmark:
    """The table of a broadcast block, made once in each worker; only the last is kept."""
    return C.hold(("benchmark", hash((len(shared.value[0]), tuple(shared.value[1])))), lambda: Benchmark(*shared.value))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, in which no item is found."""
    at = docs.columns.index("text")
    for ids, texts in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast((ids, texts))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            table = _table(shared)
            for b in batches:
                texts = C.texts_of(b.column(at))
                bad = np.zeros(len(texts), bool)
                for i, j in C.grouped(texts):
                    for t, *_ in table.matches(texts[i:j]):
                        bad[i + t] = True
                yield b.filter(pa.array(~bad))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
