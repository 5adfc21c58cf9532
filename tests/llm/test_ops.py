"""Operators against brute force, exact round trips and held-out labels, with nulls, empty and long texts, ties, repeats and odd columns."""

from __future__ import annotations

import base64
import collections
import hashlib
import html
import random
import re
import zlib

import duckdb
import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from recollect.llm import bpe, common, decontaminate, files, html_wrapper, line_dedup, minhash, ngram_join, quality, queries, sharding, token_store, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing", "ed,"]) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Null, empty, blank, tiny, long and repeated texts, a null id, a repeated id."""
    base = prose(1, 80)
    near = base.replace(base.split()[40], "changed", 1)
    texts = [None, "", "  \n\t ", "one", "two words", base, base, near, prose(2, 30_000), "a b 　c d e f", "漢字 😀 é", prose(3, 60) + "\n" + prose(4, 60)]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, (None, base, None, None, None), (5, base, "en", "s", len(base))]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return common.read(spark, oracle.SF_DIR, "documents")


def with_clashes(df):
    """The same rows with further columns whose names the operators use themselves."""
    for c in ("_key", "_block", "_first", "id", "key", "hash", "gone", "row", "bucket", "sketch", "_gone", "score", "_in", "_guard"):
        df = df.withColumn(c, F.lit("x"))
    return df


def shingles(text: str | None) -> frozenset:
    w = (text or "").split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


# 1


def test_fingerprints_follow_jaccard():
    texts = [prose(7, 400)]
    for k in (10, 60, 200):
        w = texts[0].split()
        texts.append(" ".join(w[:k] + ["new"] + w[k + 1 :] + [prose(k, k)]))
    signs = minhash.fingerprints(texts)
    for i in range(1, len(texts)):
        a, b = shingles(texts[0]), shingles(texts[i])
        assert abs(np.mean(signs[0] == signs[i]) - len(a & b) / len(a | b)) < 0.15
    assert (minhash.fingerprints(["x " * 3, "x x x"])[0] == minhash.fingerprints(["x x x"])[0]).all()


@pytest.mark.parametrize("rows", [odd_rows(), odd_rows()[:1], []])
def test_following_is_brute_force(spark, rows):
    df = with_clashes(spark.createDataFrame(rows, SCHEMA))
    got = sorted(minhash.with_following(df).collect(), key=repr)
    order = sorted(((r[0] is not None, r[0] or 0, r[1] or ""), r) for r in [(r[0], r[1]) for r in rows])
    order = [r for _, r in order]
    want = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", (order[(k + 1) % len(order)][1] or "")
        e = minhash.edited(t, nxt)
        s, n, c = minhash.fingerprints([t, nxt, e])
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), minhash.encode(s), minhash.encode(c), float(np.mean(s == c)), float(np.mean(s == n))))
    assert got == sorted(got, key=repr) and sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_following_over_many_ranges(docs):
    got = {r.doc_id: r for r in minhash.with_following(docs).collect()}
    texts = dict(docs.select("doc_id", "text").collect())
    ids = sorted(texts)
    assert sorted(got) == ids
    for k, i in enumerate(ids):
        e = minhash.edited(texts[i], texts[ids[(k + 1) % len(ids)]])
        assert got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()


def test_near_classes_are_brute_force(spark, docs, odd, none):
    assert rows_of(minhash.near_classes(docs)) == brute(docs.select("doc_id", "text").collect())
    # A is alike to B and C just below the threshold, these to each other above it: B and C keep their link.
    base = prose(31, 400).split()
    changed = lambda a, b, w: " ".join(base[:a] + [w] * (b - a) + base[b:])
    rows = odd_rows() + [(20, " ".join(base), None, None, None), (21, changed(0, 50, "p"), None, None, None), (22, changed(0, 50, "p").replace(base[399], "q"), None, None, None)]
    assert rows_of(minhash.near_classes(with_clashes(spark.createDataFrame(rows, SCHEMA)))) == brute([(r[0], r[1]) for r in rows])
    assert rows_of(minhash.near_classes(none)) == []


# 2


def test_distance():
    rng = random.Random(3)
    for _ in range(200):
        a, b = [rng.randrange(4) for _ in range(rng.randrange(1, 9))], [rng.randrange(4) for _ in range(rng.randrange(0, 14))]

        def edits(x, y):
            row = list(range(len(y) + 1))
            for i, p in enumerate(x, 1):
                row = [new := i] + [new := min(row[j] + 1, new + 1, row[j - 1] + (p != q)) for j, q in enumerate(y, 1)]
            return row[-1]

        best = min(edits(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        assert decontaminate.distance(np.array(a, np.uint64), np.array(b, np.uint64))[0] == best


def test_leaks_with_and_without_edits(spark, odd, none):
    items = [(i, prose(100 + i, 15 + i)) for i in range(40)] + [(90, None), (91, ""), (92, "three little words"), (None, "never found at all here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rng, rows, want = random.Random(5), odd_rows(), set()
    for k in range(400):
        i = k % 40
        w = items[i][1].split()
        if k >= 40:
            for at in rng.sample(range(len(w)), len(w) // 10):
                w[at] = "edited"
        at = rng.randrange(200)
        t = prose(1000 + k, 400).split()
        rows.append((100 + k, " ".join(t[:at] + [w[0].upper() + "!", *w[1:]] + t[at:]), None, None, None))
        want.add((100 + k, i))
    rows += [(900, "So Three, little WORDS.", None, None, None), (901, "three little", None, None, None)]
    df = with_clashes(spark.createDataFrame(rows, SCHEMA))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()}
    exact = {p for p in want if p[0] < 140}
    assert exact <= got and len(want - got) <= 0.02 * len(want) and got - want == {(900, 92)}
    left = {r.doc_id for r in decontaminate.clean(df, bench).collect()}
    assert left == {r[0] for r in rows} - {d for d, _ in got}
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.leaks(odd, bench.limit(0)).count() == 0
    assert decontaminate.clean(odd, bench.limit(0)).count() == odd.count()


@pytest.mark.parametrize("n", [6, 7, 8, 9, 10, 11, 12, 15, 20, 55, 75, 100, 150, 300])
def test_passages_within_a_fifth_of_edits_are_found(n):
    rng, texts, want = random.Random(n), [], set()
    items = [prose(7000 + 40 * n + i, n) for i in range(20)]
    for k in range(200):
        w, edits = items[k % 20].split(), n // 5
        if k < 20:  # all at the beginning
            w[:edits] = ["edited"] * edits
        else:
            for _ in range(edits):
                at, kind = rng.randrange(len(w)), rng.randrange(4)
                w[at : at + (kind > 0)] = [] if kind == 1 else ["edited"]
        own, at = prose(9000 + k, 120).split(), rng.choice([0, 120, rng.randrange(120)])
        texts.append(" ".join(own[:at] + w + own[at:]))
        want.add((k, k % 20))
    got = decontaminate.Benchmark(list(range(20)), items).matches([*texts, "", prose(1, 3)])
    assert len(want - {(t, k) for t, k, _, _ in got}) <= 0.05 * len(want) and all(e <= n // 5 for _, _, e, _ in got)
    words = [common.word_hashes([x], plain=True)[0] for x in items], [common.word_hashes([x], plain=True)[0] for x in texts]
    if n <= 20:
        exact = {(t, k): e for t in range(200) for k in range(20) if (e := decontaminate.distance(words[0][k], words[1][t])[0]) <= n // 5}
        assert all(exact[t, k] == e for t, k, e, _ in got) and len(got) >= 0.95 * len(exact)


@pytest.mark.parametrize("n", [6, 10, 14, 15, 40, 60, 80, 200])
@pytest.mark.parametrize("rate", [0.1, 0.2])
def test_walks_reach_their_recall(n, rate):
    """Windows, walks and samples find nineteen of twenty passages of every length at every accepted rate of edits."""
    rng, items, texts = random.Random(100 * n + int(100 * rate)), [prose(7000 + 40 * n + i, n) for i in range(20)], []
    for k in range(100):
        w = items[k % 20].split()
        for _ in range(int(n * rate + 1e-9)):
            at, kind = rng.randrange(len(w)), rng.randrange(4)
            w[at : at + (kind > 0)] = [] if kind == 1 else ["edited"]
        own, at = prose(9000 + k, 100).split(), rng.randrange(100)
        texts.append(" ".join(own[:at] + w + own[at:]))
    found = {(t, k) for t, k, _, _ in decontaminate.Benchmark(list(range(20)), items).matches(texts)}
    assert len(found & {(k, k % 20) for k in range(100)}) >= 95


def test_nothing_is_found_without_walks(monkeypatch):
    items = [prose(7000 + i, 30) for i in range(5)]
    table = decontaminate.Benchmark(list(range(5)), items)
    assert {(t, k) for t, k, _, _ in table.matches(items)} == {(k, k) for k in range(5)}
    monkeypatch.setattr(table, "walks", {})
    assert table.matches(items) == []


def test_leaks_are_those_of_sql(spark, docs):
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, common.read(spark, oracle.SF_DIR, "benchmark")).where("edits = 0").collect()}
    norm = lambda t: " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower()))
    items = {r.item_id: norm(r.text) for r in common.read(spark, oracle.SF_DIR, "benchmark").collect()}
    assert got == {(d.doc_id, i) for d in docs.collect() for i, t in items.items() if t in norm(d.text)}


# 3


def test_random_access():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 1 << 20, 5000) >> rng.integers(0, 20, 5000)
    f = token_store.TokenFile(b"".join(token_store.dump(np.arange(3), np.array([0, 10, 10, 5000]), ids)))
    assert [f.token(i) for i in range(0, 5000, 7)] == ids[::7].tolist()
    for i, j in rng.integers(0, 5001, (200, 2)):
        assert f.slice(i, j).tolist() == ids[i:j].tolist()
    assert f.document(1).tolist() == [] and f.document(2).tolist() == ids[10:].tolist()
    empty = token_store.TokenFile(b"".join(token_store.dump(np.arange(0), np.array([0]), ids[:0])))
    assert len(empty) == 0 and empty.slice(0, 5).tolist() == []
    with pytest.raises(IndexError):
        f.token(5000)


def test_look_ups_read_ranges_of_a_file(tmp_path):
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 50_000, 200_000)
    whole = b"".join(token_store.dump(np.arange(2), np.array([0, 7, 200_000]), ids))
    (tmp_path / "t.dac").write_bytes(whole)
    with files.ranged(f"file://{tmp_path}/t.dac") as opened:

        class Counted:
            read = 0

            def read_at(self, n, at):
                self.read += n
                return opened.read_at(n, at)

        counted = Counted()
        f = token_store.TokenFile(counted)
        counted.read = 0
        assert [f.token(i) for i in range(0, 200_000, 2001)] == ids[::2001].tolist()
        assert f.document(1).tolist() == ids[7:].tolist() and f.slice(100, 130).tolist() == ids[100:130].tolist()
        counted.read = 0
        f.token(123_456)
        assert counted.read < 300


def test_large_blocks_make_several_files(spark):
    path = queries.vocabulary("word_bpe_49k.json")
    df = spark.createDataFrame([(i, "one two three " * (i % 9)) for i in range(300)], "doc_id long, text string")
    manifest = token_store.write(df, common.shared_dir(spark, "tokens"), path, file_ids=100)
    assert manifest.count() > 20
    key = lambda r: r.doc_id
    assert sorted(token_store.read(spark, manifest).collect(), key=key) == sorted(token_store.stored(spark, df, path).collect(), key=key)


def test_token_files_hold_the_librarys_ids(spark, odd, none, docs):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    for df in (with_clashes(odd), docs):
        rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or ""), r.doc_id) for r in df.collect())
        start, want = 0, []
        for (_, _, text), i in rows:
            ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
            want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_store.stored(spark, df, path).collect()]
        assert sorted(got, key=lambda r: r[1]) == want
    assert token_store.stored(spark, none, path).count() == 0


def test_encoder_is_the_library():
    e, rng = token_store.Encoder(queries.vocabulary("word_bpe_49k.json")), random.Random(2)
    parts = [" ", "  ", "\n", "\t", "\x0b", "\x85", "the", "THE", "ß", "é", "É", "漢字", "😀", "'s", "'", "12", "...", "$$$", "é", "İ", "ﬁ", "<|endoftext|>", "ing", ",", "!!"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(3000)]
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for t in texts for x in e([t])] == want
    assert [x.tolist() for i in range(0, 3000, 97) for x in e(texts[i : i + 97])] == want
    e.MOST = 50  # the table starts anew
    assert e.by_pieces and [x.tolist() for i in range(0, 3000, 97) for x in e(texts[i : i + 97])] == want
    e.LONGEST = 3  # longer pieces get rows of their own, whatever their hash
    assert [x.tolist() for i in range(0, 3000, 97) for x in e(texts[i : i + 97])] == want
    other = token_store.Encoder(queries.vocabulary("byte_bpe_50k.json"))
    assert not other.by_pieces and [x.tolist() for x in other(texts[:200])] == [x.ids for x in other.tokenizer.encode_batch(texts[:200], add_special_tokens=False)]


@pytest.mark.parametrize("most", [1, 3, 50, 1000])
def test_tables_of_any_size(most):
    e, rng = token_store.Encoder(queries.vocabulary("word_bpe_49k.json")), random.Random(most)
    e.MOST = most
    e._forget()
    texts = [" ".join(rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(rng.randrange(60))) for _ in range(300)]
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for i in range(0, 300, 31) for x in e(texts[i : i + 31])] == want


def test_pieces_of_one_hash_are_told_apart(monkeypatch):
    hashes = common.span_hashes
    monkeypatch.setattr(common, "span_hashes", lambda *a: (hashes(*a) % np.uint64(7)) << np.uint64(40))
    e = token_store.Encoder(queries.vocabulary("word_bpe_49k.json"))
    texts = [prose(i, 40) + f" x{i}y é漢 {i}" for i in range(60)]
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for i in range(0, 60, 7) for x in e(texts[i : i + 7])] == want


# 4


def test_bpe_is_tiktoken(docs):
    import tiktoken

    c = bpe.Codec(queries.vocabulary("byte_bpe_multi_50k.tiktoken"), queries.split_pattern())
    ref = tiktoken.Encoding("own", pat_str=queries.split_pattern(), mergeable_ranks=c.merges.ranks, special_tokens={})
    rng = random.Random(4)
    parts = ["  ", "\n", "\n ", "\t", " ", " ", "a", "the", "ß", "漢字", "😀", "'s", "'", "12", "...", "$$$", "é", "́", "\r\n", "ing", " <|endoftext|>", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(5000)]
    texts += ["".join(rng.choice("abceinort") for _ in range(rng.randrange(1, 3000))) for _ in range(200)]
    texts += [r.text for r in docs.limit(300).collect()]
    for t in texts:
        ids = c.encode(t).tolist()
        assert ids == ref.encode_ordinary(t)
        assert c.decode(ids) == t.encode()
        assert "".join(c.decode_stream([i] for i in ids)) == t


def test_utf8_machine():
    data = "aé漢😀z".encode() + b"\xff\xe6\xbc" + b"b"
    for n in (1, 2, 3, 5):
        u = bpe.Utf8()
        assert "".join(u.feed(data[i : i + n]) for i in range(0, len(data), n)) + u.feed(b"", True) == data.decode("utf-8", "replace")


def test_utf8_machine_on_any_bytes():
    rng = random.Random(6)
    pool = [*"aé漢😀".encode(), 0x80, 0xBF, 0xC0, 0xC1, 0xE0, 0xED, 0xA0, 0x9F, 0xF0, 0xF4, 0x90, 0xF5, 0xFF]
    for _ in range(5000):
        data, u, at = bytes(rng.choice(pool) for _ in range(rng.randrange(12))), bpe.Utf8(), 0
        text = ""
        while at < len(data):
            n = rng.randrange(1, 4)
            text, at = text + u.feed(data[at : at + n]), at + n
        assert text + u.feed(b"", True) == data.decode("utf-8", "replace")


def test_bpe_round_trip(spark, odd, none):
    path, pattern = queries.vocabulary("byte_bpe_multi_50k.tiktoken"), queries.split_pattern()
    got = sorted((str(r.doc_id), r.decoded_sha256, r.n_tokens > 0) for r in bpe.round_trip(with_clashes(odd), path, pattern).collect())
    assert got == sorted((str(r[0]), hashlib.sha256((r[1] or "").encode()).hexdigest(), bool(r[1])) for r in odd_rows())
    back = bpe.decode(bpe.encode(odd, path, pattern), path, pattern, part=3)
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(r[0]), r[1] or "") for r in odd_rows())
    texts = sorted((str(r.doc_id), r.text) for r in bpe.round_trip(odd, path, pattern, with_text=True, part=2).collect())
    assert texts == sorted((str(r[0]), r[1] or "") for r in odd_rows())
    assert bpe.round_trip(none, path, pattern).count() == 0


# 5


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "</p><article>";</script><style>p{{}}</style></head><body>
<header><a href="/">Home</a></header><nav><ul>{links}</ul></nav><div class="ad">Buy</div><div id="cookie-notice">We use cookies</div>
<article><h1>{title}</h1><!-- no <p>this</p> --><p>One  &amp; <b>two</b>three<br>four&nbsp;five</p>{body}<aside>See also</aside><form><input>Send</form></article>
<div class="sidebar">Side</div><section id="comments"><p>First!</p></section><footer>&copy; me</footer></body></html>"""


def test_html_text(spark):
    rows = [(i, f"https://a.example/{i}", PAGE.format(title=f"Title {i}", links="<li><a>x</a>" * (i + 1), body="".join(f"<p>Body {i} {k}<p>Next" for k in range(i)))) for i in range(5)]
    want = {i: " ".join([f"Title {i}", "One & twothree four five", *[f"Body {i} {k} Next" for k in range(i)]]) for i in range(5)}
    rows += [(10, None, None), (11, "no url", ""), (12, "https://b.example/", "<p>Loose <b>text"), (12, "https://b.example/", "<p>Loose <b>text"), (None, "https://c.example/", "a < b &lt; c")]
    got = [(r.page_id, r.text, r.n_chars) for r in html_wrapper.extracted(with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()]
    assert sorted(got, key=repr) == sorted([*[(i, t, len(t)) for i, t in want.items()], (10, "", 0), (11, "", 0), (12, "Loose text", 10), (12, "Loose text", 10), (None, "a < b < c", 9)], key=repr)
    assert html_wrapper.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_without_article(spark):
    page = "<html><body><div class='menu'><a>Home</a></div><div><p>Same on all pages of this host</p><h2>Head {0}</h2><p>Story {0}</p><ul><li><a href='/'>More</a></li></ul></div></body></html>"
    rows = [(i, f"http://x.example/{i}", page.format(i)) for i in range(6)]
    got = {r.page_id: r.text for r in html_wrapper.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Head {i} Story {i}" for i in range(6)}


def test_wrapper_aligning():
    w = lambda s: html_wrapper.wrapper(html_wrapper.tree(s))
    a, b, c = w("<ul><li>1<li>2</ul><p>x</p>"), w("<ul><li>3</ul><h2>t</h2><p>x</p>"), w("<p>x</p><h2>t</h2><p>y</p>")
    assert html_wrapper.written(html_wrapper.aligned(a, b)) == "(<ul>(<li>#text</>)+</>)(<h2>#same</>)?(<p>#same</>)"
    assert "(" in html_wrapper.written(html_wrapper.aligned(html_wrapper.aligned(a, b), c))
    assert html_wrapper.written(html_wrapper.aligned(a, a)) == html_wrapper.written(a)
    assert html_wrapper.aligned(a, b)[0][2][0][2] == [["#", "1", [], [3, 0, 2]]]  # three characters in two pages


def test_what_the_wrapper_tells(spark):
    """Inside an article: constant texts of any length and number, and lists of links; an article that holds little; an empty wrapper."""
    notices = "".join(f"<p>{prose(600 + k, 60)}</p>" for k in range(50))
    page = "<html><body><article><h1>Head {0}</h1>" + notices + "<p>Story {0}</p><p>{1}</p><div><a href='/a'>x {0}</a><a href='/b'>y {0}</a></div></article></body></html>"
    own = [prose(660 + i, 4000) for i in range(8)]
    sources = [page.format(i, own[i]) for i in range(8)]
    df = lambda rows: spark.createDataFrame([(i, "http://n.example/", t) for i, t in enumerate(rows)], "page_id long, url string, html string")
    read = lambda rows: {r.page_id: r.text for r in html_wrapper.extracted(df(rows)).collect()}
    assert read(sources) == {i: f"Head {i} Story {i} {own[i]}" for i in range(8)}
    whole = html_wrapper.wrapper(html_wrapper.tree(sources[0]))
    assert html_wrapper.Reader([], 8).read(sources[0]) == "" and "Story 0" in html_wrapper.Reader(whole, 1).read(sources[0])
    few = read(sources[:3])  # too few pages to tell
    assert all(prose(600, 60) in t for t in few.values())
    same = read([sources[0]] * 9)  # copies of one page: what all have is not chrome
    assert all("Story 0" in t and prose(649, 60) in t for t in same.values())
    teaser = "<html><body><article><p>Teaser {0}</p></article><div><h2>Real {0}</h2>" + "".join(f"<p>Long text {{0}} {k} of the page</p>" for k in range(9)) + "</div></body></html>"
    assert read([teaser.format(i) for i in range(4)]) == {i: f"Teaser {i} Real {i} " + " ".join(f"Long text {i} {k} of the page" for k in range(9)) for i in range(4)}
    # Wrappers too large for a broadcast go out with salts.
    salted = {r.page_id: r.text for r in html_wrapper.extracted(df(sources), most_broadcast=0, salts=3).collect()}
    assert salted == read(sources)


def read_pages(spark, sources: list[str], **how) -> list[str]:
    df = spark.createDataFrame([(i, "http://d.example/", t) for i, t in enumerate(sources)], "page_id long, url string, html string")
    return [r.text for r in html_wrapper.extracted(df, **how).orderBy("page_id").collect()]


@pytest.mark.parametrize("n", [1, 2, 5, 8, 30])
def test_headings_stay_however_many_pages_have_them(spark, n):
    page = "<html><body><article><h1>T{0}</h1><h2>Summary</h2><p>{1}</p><h2>Conclusion</h2><p>{2}</p><table><tr><th>Price<td>{0}</table></article></body></html>"
    own = [(prose(i, 40), prose(99 + i, 40)) for i in range(n)]
    assert read_pages(spark, [page.format(i, *own[i]) for i in range(n)]) == [f"T{i} Summary {a} Conclusion {b} Price {i}" for i, (a, b) in enumerate(own)]


def test_aligned_pages_tell_what_one_page_does_not(spark):
    """A line that all pages of a host have in the article goes once it can be no accident; on its own a page keeps it, as do copies of one page."""
    page = "<html><body><article><h1>T{0}</h1><p>Read this with our app.</p><p>{1}</p><p>{2}</p></article></body></html>"
    sources = [page.format(i, prose(i, 50), prose(50 + i, 50)) for i in range(12)]
    whole = [f"T{i} Read this with our app. {prose(i, 50)} {prose(50 + i, 50)}" for i in range(12)]
    assert read_pages(spark, sources) == [t.replace(" Read this with our app.", "") for t in whole]
    assert read_pages(spark, sources[:1]) == whole[:1] and read_pages(spark, sources[:2]) == whole[:2]
    assert read_pages(spark, sources[:1] * 12) == whole[:1] * 12


@pytest.mark.parametrize("depth", [150, 1500, 20_000])
def test_deep_pages_are_read(spark, depth):
    page = "<html><body>" + "<div>" * depth + "<article><p>{0}</p><nav>menu</nav>" + "<section>" * depth + "<p>in{0}</p>" + "</section>" * depth + "</article>" + "</div>" * depth + "<p>out</p></body></html>"
    assert read_pages(spark, [page.format(i) for i in range(3)]) == [f"{i} in{i}" for i in range(3)]
    assert read_pages(spark, ["<p>a" + "<b><div>" * depth + "b" + "<div class=ad>" + "<div>" * 9 + "x" + "</div>" * 10 + "c"]) == ["a b c"]


def test_names_of_chrome(spark):
    page = "<article><div class='header'><h1>H</h1></div><div class='share-price'>12</div><div class='share-buttons'>no</div><div id='cookie-notice'>no</div><math><mi>x</mi><mo>=</mo><mn>1</mn></math> <button>go</button><div class='nav ad'>no</div></article><div class='header'>no</div><footer>no</footer>"
    assert read_pages(spark, [page, page.replace("12", "13")]) == ["H 12 x=1 go", "H 13 x=1 go"]


def test_html_pages_without_any_article_element(spark):
    """The driver's pages with div elements in the article's place: the host's text, but for chrome, is what is left."""
    pages = common.read(spark, oracle.SF_DIR, "pages")
    plain = pages.withColumn("html", F.regexp_replace(F.regexp_replace("html", "<article>", "<div>"), "</article>", "</div>"))
    a = {r.page_id: r.text for r in html_wrapper.extracted(pages).collect()}
    b = {r.page_id: r.text for r in html_wrapper.extracted(plain).collect()}
    assert a == b


def test_html_whole_table(spark):
    def main(source):
        body = re.sub(r"</?(p|h1|article)>|<br>", "\0", source[source.index("<article>") + 9 :].split("</article>")[0])
        parts = re.sub(r"<[^>]*>", "", body).split("\0")
        return " ".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)

    pages = common.read(spark, oracle.SF_DIR, "pages")
    got = {r.page_id: r.text for r in html_wrapper.extracted(pages).collect()}
    assert got == {r.page_id: main(r.html) for r in pages.collect()}


# 6


def test_quality_held_out(spark, docs):
    labels = common.read(spark, oracle.SF_DIR, "labels")
    got = quality.scored(docs, quality.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 40 and np.mean([r.predicted == r.quality for r in got]) >= 0.95
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in got)
    # Labels of held-out rows are never learnt from.
    flipped = labels.withColumn("quality", F.when(quality.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, flipped)
    assert (a.weights == b.weights).all() and (a.value == b.value).all()


def test_quality_odd_rows(spark, odd, none, docs):
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0), (5, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    m = quality.fit(odd, labels)
    assert m.weights is None and quality.scored(with_clashes(odd), m).count() == odd.count()
    assert quality.fit(odd, labels.limit(0)).score(np.zeros((1, len(quality.NAMES))))[0] == 1.0
    m = quality.fit(docs, common.read(spark, oracle.SF_DIR, "labels"))
    scores = quality.scored(odd, m).collect()
    assert len(scores) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in scores)
    assert quality.scored(none, m).count() == 0 and quality.kept(none, m).count() == 0
    kept = quality.kept(with_clashes(odd), m)
    assert kept.columns == with_clashes(odd).columns and kept.count() == sum(r.predicted for r in scores)


def statistics(text: str | None) -> list[float]:
    """The classifier's inputs in plain Python."""
    words = [w.encode() for w in (text or "").split()]
    if not words:
        return [0.0] * len(quality.NAMES)
    data, n, w, lines = text.encode(), len(text.encode()), len(words), text.split("\n")
    size = [len(x) for x in words]
    mean = sum(size) / w
    symbols = [data.count(c) for c in b"#$%&*@^_~"]
    pairs = [a == b for a, b in zip(words, words[1:])]
    twos = [a == b for a, b in zip(words, words[2:])]
    values = [
        sum(65 <= c < 91 for c in data) / n, sum(48 <= c < 58 for c in data) / n, data.count(b"|") / w, data.count(b"!") / w, sum(symbols) / w, (data.count(b",") + data.count(b".")) / w, sum(c in b"\t\n " for c in data) / n, sum(c >= 128 for c in data) / n,
        min(mean, 40) / 10, sum(x > 15 for x in size) / w, len(set(words)) / w, sum(pairs) / len(pairs) if pairs else 0.0, sum(twos) / len(twos) if twos else 0.0,
        np.log1p(w / len(lines)) / 5, 1 - len(set(lines)) / len(lines), np.log1p(w) / 8, min((sum((x - mean) ** 2 for x in size) / w) ** 0.5, 30) / 10, max(symbols) / w,
    ]
    return [min(max(v, 0), 4) ** 0.5 for v in values]


def test_quality_is_brute_force(spark, docs):
    """Features, Fourier map, ridge fit (by least squares instead of normal equations) and calibration (by its min-max formula), recomputed in one piece."""
    labels = common.read(spark, oracle.SF_DIR, "labels")
    got = {r.doc_id: (r.score, r.predicted, r.held_out) for r in quality.scored(docs, quality.fit(docs, labels)).collect()}
    texts = dict(docs.select("doc_id", "text").collect())
    crc = lambda i: zlib.crc32(str(i).encode()) % 5
    known = [(i, q) for i, q in labels.select("doc_id", "quality").collect() if crc(i) != 0 and i in texts]
    x, y, fold = np.array([statistics(texts[i]) for i, _ in known]), np.array([float(q) for _, q in known]), np.array([crc(i) for i, _ in known])
    d = x.shape[1]
    rng = np.random.default_rng(11)
    directions, phases = rng.normal(0, d**-0.5, (d, 256)), rng.uniform(0, 2 * np.pi, 256)
    mean, scale = x.mean(axis=0), np.sqrt(np.maximum((x * x).mean(axis=0) - x.mean(axis=0) ** 2, 1e-6))

    def mapped(x):
        z = np.clip((x - mean) / scale, -6, 6)
        return np.hstack([np.cos(z @ directions + phases) * np.sqrt(2 / 256), z, np.ones((len(x), 1))])

    weight = np.sqrt(np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))))
    rest, k = fold != 1, 256 + d + 1
    a = np.vstack([mapped(x[rest]) * weight[rest, None], np.sqrt(1e-3 * len(y) / k) * np.eye(k)])
    w = np.linalg.lstsq(a, np.concatenate([y[rest] * weight[rest], np.zeros(k)]), rcond=None)[0]
    edges = np.linspace(-0.5, 1.5, 201)
    use = fold == 1 if (fold == 1).sum() >= 50 else np.ones(len(y), bool)
    at = np.clip(np.searchsorted(edges, mapped(x[use]) @ w) - 1, 0, 199)
    bins = sorted(set(at.tolist()))
    total, good = [float((at == b).sum()) for b in bins], [float(y[use][at == b].sum()) for b in bins]
    share = lambda i, j: sum(good[i : j + 1]) / sum(total[i : j + 1])
    value = [max(min(share(i, j) for j in range(m, len(bins))) for i in range(m + 1)) for m in range(len(bins))]
    middle = [(edges[b] + edges[b + 1]) / 2 for b in bins]
    want = np.clip(np.interp(mapped(np.array([statistics(t) for t in texts.values()])) @ w, middle, value), 0, 1)
    for i, score in zip(texts, want, strict=True):
        assert got[i][0] == pytest.approx(score, abs=1e-6) and got[i][1] == int(got[i][0] >= 0.3) and got[i][2] == (crc(i) == 0)


def test_isotonic():
    assert quality.isotonic(np.array([1.0, 1, 2, 1]), np.array([0.0, 1, 0, 1])).tolist() == pytest.approx([0, 1 / 3, 1 / 3, 1])


# 7


def brute(rows: list[tuple]) -> list[tuple]:
    """(doc_id, class_id, text_id, n_copies, n_links) of each row, sorted."""
    rows = [(i, t or "") for i, t in rows]
    ids, copies = collections.defaultdict(list), collections.Counter(t for _, t in rows)
    for i, t in rows:
        ids[t] += [] if i is None else [i]
    sets = {t: shingles(t) for t in ids}
    at = collections.defaultdict(list)
    for t, s in sets.items():
        for x in s:
            at[x].append(t)
    both = collections.Counter((a, b) for ts in at.values() for k, a in enumerate(ts) for b in ts[k + 1 :])
    links, up = collections.Counter(), {t: t for t in sets}

    def top(t):
        while up[t] != t:
            t = up[t]
        return t

    for (a, b), n in both.items():
        if n / (len(sets[a]) + len(sets[b]) - n) >= 0.8 - 1e-12:
            links[a] += 1
            links[b] += 1
            a, b = top(a), top(b)
            if a != b:
                up[b] = a
    of_class = collections.defaultdict(list)
    for t in sets:
        of_class[top(t)] += ids[t]
    return sorted(((i, min(of_class[top(t)], default=None), min(ids[t], default=None), copies[t], links[t]) for i, t in rows), key=repr)


def rows_of(df) -> list[tuple]:
    return sorted(((r.doc_id, r.class_id, r.text_id, r.n_copies, r.n_links) for r in df.collect()), key=repr)


def test_join_is_brute_force(spark, docs, odd, none):
    assert rows_of(ngram_join.classes(docs)) == brute(docs.select("doc_id", "text").collect())
    assert rows_of(ngram_join.classes(with_clashes(odd))) == brute([(r[0], r[1]) for r in odd_rows()])
    assert rows_of(ngram_join.classes(none)) == []


def test_hot_keys_are_dealt(spark, docs, monkeypatch):
    """Every join of a common key through its salted form."""
    monkeypatch.setattr(common, "HOT_ROWS", 1)
    monkeypatch.setattr(common, "SALTS", 3)
    some = docs.limit(250)
    assert rows_of(ngram_join.classes(some)) == brute(some.select("doc_id", "text").collect())
    a = {r.doc_id: r.text for r in line_dedup.cleaned(some).collect()}
    pages = spark.createDataFrame([(i, f"http://h/{i}", "same" if i % 3 else f"own {i}") for i in range(60)], "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.archived(spark, pages).collect()}
    assert got == {i: ("response", None) if i % 3 == 0 or i == 59 else ("revisit", 59) for i in range(60)}
    monkeypatch.undo()
    assert a == {r.doc_id: r.text for r in line_dedup.cleaned(some).collect()}


def test_join_of_a_large_group(spark):
    rng, base = random.Random(9), prose(50, 200).split()
    rows = []
    for i in range(700):  # more than one tile; some pairs at the threshold or beyond it
        w = list(base)
        for at in rng.sample(range(200), rng.choice([0, 1, 1, 2, 3, 5])):
            w[at] = f"w{rng.randrange(3)}"
        rows.append((i, " ".join(w), None, None, None))
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(ngram_join.classes(df)) == brute([(r[0], r[1]) for r in rows])
    kept = sorted(r.doc_id for r in ngram_join.one_of_each(df).collect())
    assert kept == sorted({c for _, c, *_ in brute([(r[0], r[1]) for r in rows])})


def test_one_of_each_keeps_columns(odd):
    df = with_clashes(odd)
    out = ngram_join.one_of_each(df)
    assert out.columns == df.columns
    # Texts 5, 6, 7, the repeated 5 and the text without an id are one group; null and "" are one text, "  \n\t " another.
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(map(str, [0, 2, 3, 4, 5, 8, 9, 10, 11]))


def test_one_of_each_keeps_different_texts_of_one_id(spark):
    base, own = prose(41, 90), [prose(42 + k, 90) for k in range(6)]
    near = base.replace(base.split()[40], "changed", 1)
    rows = [(5, own[0]), (5, own[1]), (8, near), (8, own[2]), (3, base), (None, own[3]), (None, own[4]), (None, near), (None, own[4]), (9, own[5]), (9, own[5])]
    got = sorted(((r.doc_id, r.text) for r in ngram_join.one_of_each(spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)).collect()), key=repr)
    assert got == sorted([(5, own[0]), (5, own[1]), (8, own[2]), (3, base), (None, own[3]), (None, own[4]), (9, own[5])], key=repr)


# 8


def test_shards(spark, odd, none, docs):
    for df in (docs, with_clashes(odd)):
        got, want = sharding.assign(df).collect(), df.select("doc_id", "text").collect()
        assert len(got) == len(want)
        assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in want)
        slots = collections.defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
            assert r.law == "key" and 0 <= r.shard < 8 and r.grown_shard in (r.shard, 8)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert len({(r.doc_id, r.shard, r.grown_shard) for r in got}) == len({r.doc_id for r in got})
    sizes = collections.Counter(r.shard for r in sharding.assign(docs).collect())
    assert max(sizes.values()) < 1.4 * min(sizes.values())
    assert sharding.assign(none).count() == 0


def drawn(doc_id: int | None, layout: list[tuple]) -> int:
    """The descent in plain Python: Spark's xxhash64 hashes one value after the other, each with the hash so far as its seed, and leaves nulls out."""
    import math
    import struct

    import xxhash

    def draw(name: str, weight: float) -> float:
        seed = 42 if doc_id is None else xxhash.xxh64(struct.pack("<q", doc_id), seed=42).intdigest()
        return -math.log(((xxhash.xxh64(name.encode(), seed=seed).intdigest() >> 11) + 0.5) / (1 << 53)) / weight

    live = [x for x in layout if x[3] > 0]
    for level in range(3):
        name = (lambda x: f"region/{x[0]}", lambda x: f"rack/{x[0]}/{x[1]}", lambda x: f"shard/{x[2]}")[level]
        weights = collections.defaultdict(float)
        for x in live:
            weights[name(x)] += x[3]
        best = min(weights, key=lambda n: draw(n, weights[n]))
        live = [x for x in live if name(x) == best]
    return live[0][2]


def test_shards_are_brute_force(spark):
    ids = [None, 0, -1, 1 << 62, *range(1, 400)]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    odd = [("a", "x", 0, 1.0), ("a", "x", 1, 3.0), ("a", "y", 2, 0.0), ("b", "z", 3, 0.5), ("b", "w", 4, 2.5), ("c", "v", 5, 1.0)]
    for layout in (sharding.LAYOUT, sharding.grown(sharding.LAYOUT), odd):
        got = {r.doc_id: r.s for r in df.select("doc_id", sharding.shard_of(F.col("doc_id"), layout).alias("s")).collect()}
        assert got == {i: drawn(i, layout) for i in ids}


def test_weights_move_only_between_changed_subtrees(spark):
    keys = spark.range(20000)
    heavy = [(r, k, s, 3.0 if s == 5 else w) for r, k, s, w in sharding.LAYOUT]
    rows = keys.select(sharding.shard_of(F.col("id")).alias("a"), sharding.shard_of(F.col("id"), heavy).alias("b")).groupBy("a", "b").count().collect()
    total = collections.Counter()
    for r in rows:
        total[r.b] += r["count"]
        assert r.a == r.b or r.b // 4 == 1  # moves go into the changed region only, never out of it into the other
    assert abs(total[5] / 20000 - 0.3) < 0.02


# 9


def test_lines(spark, none):
    passage = "\n".join(prose(60 + k, 20) for k in range(4))
    long = prose(70, 60)
    rows = [(i, "\n".join([prose(200 + i, 12), passage if i % 2 else prose(300 + i, 12), prose(400 + i, 9), long, prose(500 + i, 11)]), None, None, None) for i in range(12)]
    rows += [(50, None, None, None, None), (51, "", None, None, None), (52, "\n\n", None, None, None), (None, long, None, None, None), (53, "All rights reserved.", None, None, None), (54, "All rights reserved.", None, None, None), (55, long + "\nx\n" + long, None, None, None)]
    df = with_clashes(spark.createDataFrame(rows, SCHEMA))
    out = line_dedup.cleaned(df)
    assert out.columns == [*df.columns, "_removed_lines"]
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[50] is None and got[51] == "" and got[52] == "\n\n" and got[53] == got[54] == "All rights reserved." and got[55] == "x"
    assert sum(long in (t or "") for t in got.values()) == 1 and got[None] == long
    last = passage.split("\n")[-1]
    assert sum(last in (t or "") for t in got.values()) == 1 and sum(passage in (t or "") for t in got.values()) <= 1
    for i in range(12):  # what is a document's own stays
        assert all(prose(s + i, n) in got[i] for s, n in ((200, 12), (400, 9), (500, 11)))
    assert line_dedup.cleaned(none).count() == 0


def test_lines_whole_table(docs):
    got = {r.doc_id: r.text for r in line_dedup.cleaned(docs).collect()}
    before, after = collections.Counter(), collections.Counter()
    texts = dict(docs.select("doc_id", "text").collect())
    for i, t in texts.items():
        before.update(set(t.split("\n")))
        after.update(set(got[i].split("\n")))
    assert set(after) - {""} == set(before) - {""}  # no line is lost from the corpus
    assert all(after[x] == 1 for x, n in before.items() if len(x.split()) >= 50)
    lines = collections.Counter(x for t in texts.values() for x in t.split("\n"))
    once = [i for i, t in texts.items() if all(lines[x] == 1 for x in t.split("\n"))]
    assert once and all(got[i] == texts[i] for i in once)


def test_chunks_are_compared_by_bytes(spark):
    # Same words, other white space: one hash, different bytes.
    a, b = prose(80, 60), prose(80, 60).replace(" ", "  ")
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate([a, b, a, b, b])], SCHEMA)
    assert [r.text for r in line_dedup.cleaned(df).orderBy("doc_id").collect()] == [a, b, "", "", ""]


def test_every_copy_of_a_short_passage_goes_whole(spark):
    passages = [[prose(1000 + 10 * p + k, words) for k in range(lines)] for p, (lines, words) in enumerate([(2, 30)] * 12 + [(3, 20)] * 8 + [(8, 9)] * 4)]
    passages.append([prose(1900, 30), "", prose(1901, 30)])
    own = {c: [prose(3000 + 3 * c + k, 12) for k in range(3)] for c in range(20)}
    rows = []
    for c, (a, b, z) in own.items():
        for p, lines in enumerate(passages):
            rows.append((100 * p + c, "\n".join([f"{a} {p}", f"{b} {p}", *lines, f"{z} {p}"]), None, None, None))
    got = {r.doc_id: r.text for r in line_dedup.cleaned(spark.createDataFrame(rows, SCHEMA)).collect()}
    for p, lines in enumerate(passages):
        assert "\n".join(lines) in got[100 * p]
        for c in range(1, 20):
            assert got[100 * p + c] == "\n".join(f"{x} {p}" for x in own[c])


def test_first_occurrence_stays_where_copies_overlap_it(spark):
    a, b = prose(90, 30), prose(91, 30)
    rows = [(1, "\n".join([a, a, a])), (2, "\n".join([b, a, a, b, a]))]
    got = {r.doc_id: r.text for r in line_dedup.cleaned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: f"{a}\n{a}", 2: f"{b}"}


def cleaned_by_brute_force(rows: list[tuple]) -> list[tuple]:
    """(doc_id, cleaned text) of (doc_id, text, hash) rows: every occurrence of a chunk's bytes but the first goes."""
    lines = {r: (r[1] or "").split("\n") for r in rows}
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    at = collections.defaultdict(list)
    for n, r in enumerate(order):
        filled = [k for k, x in enumerate(lines[r]) if x.split()]
        for a, b in [*zip(filled, filled[1:]), *((k, k) for k in filled if len(lines[r][k].split()) >= line_dedup.LONG)]:
            at["\n".join(lines[r][a : b + 1])].append((n, a, b + 1))
    gone = collections.defaultdict(set)
    for places in at.values():
        (n0, _, end), *later = sorted(places)
        for n, a, b in later:
            gone[order[n]].update(range(max(a, end) if n == n0 else a, b))
    return sorted(((r[0], r[1] if r[1] is None else "\n".join(x for k, x in enumerate(lines[r]) if k not in gone[r])) for r in rows), key=repr)


def test_lines_are_brute_force(spark, docs):
    known = lambda df: [tuple(r) for r in df.select("doc_id", "text", F.xxhash64("text")).collect()]
    rng, pool = random.Random(12), [prose(700 + k, 8 + 7 * (k % 8)) for k in range(30)] + ["", " "]
    passage = [prose(790 + k, 20) for k in range(4)]
    own = lambda k, n: [prose(810 + 10 * k + i, 15) for i in range(n)]
    rows = [(rng.choice([None, 1, 2, 3, 4]), "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 12)))) for _ in range(120)]
    rows += [(None, "\n".join(own(0, 6))), (None, "\n".join(passage + own(1, 3))), (None, "\n".join(own(2, 2) + passage)), (7, "\n".join(own(3, 6))), (7, "\n".join(own(4, 2) + passage)), (7, None), (None, None), (7, "\n".join(own(3, 6)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in line_dedup.cleaned(df).collect()), key=repr)
    assert got == cleaned_by_brute_force(known(df))
    texts = [t or "" for _, t in got]
    assert all(any(x in t for t in texts) for k, n in ((0, 6), (1, 3), (2, 2), (3, 6), (4, 2)) for x in own(k, n)) and sum(passage[2] in t for t in texts) == 1
    assert sorted(((r.doc_id, r.text) for r in line_dedup.cleaned(docs).collect()), key=repr) == cleaned_by_brute_force(known(docs))


# 10


def test_warc(spark):
    rows = [(1, "http://a/", "x" * 50), (2, "http://b/", "x" * 50), (3, None, None), (4, "http://c/\r\nEvil: 1", ""), (5, "http://d/", "é\r\n\r\n\x00" * 9), (None, "http://e/", "y"), (7, "http://f/", "z" * 300_000), (2, "http://b/", "x" * 50)]
    df = with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = sorted((tuple(r) for r in warc.archived(spark, df).collect()), key=repr)
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    refers = {1: 2, 3: 4}
    want = [(i, len((t or "").encode()), sha(t), "revisit" if i in refers else "response", refers.get(i)) for i, _, t in rows]
    assert got == sorted(want, key=repr)
    assert warc.archived(spark, df.limit(0)).count() == 0
    assert {r[3] for r in warc.archived(spark, df, least_bytes=1000).collect()} == {"response"}


def test_warc_members_and_payloads(spark, tmp_path):
    import gzip

    df = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>" * i) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write(df, f"file://{tmp_path}")
    assert {r.page_id: r.payload.decode() for r in warc.read(spark, manifest).collect()} == {i: f"<p>{i}</p>" * i for i in range(20)}
    data = b"".join(p.read_bytes() for p in sorted(tmp_path.glob("*.warc.gz")))
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 20
    for n in (1, 7, 10_000):
        assert len(list(warc.records(iter([data[i : i + n] for i in range(0, len(data), n)])))) == 20
    with pytest.raises(ValueError):
        list(warc.records(iter([data[:-5]])))
    first = warc.record(1, "http://h/", "response", None, b"<p>payload</p>" * 20, 280, "x")
    for at in range(1, len(first)):  # an archive that breaks off at any byte of its first or second record
        for cut, whole in ((first[:at], 0), (first + first[:at], 1)):
            got = []
            with pytest.raises(ValueError):
                for r in warc.records(iter([cut])):
                    got.append(r)
            assert len(got) == whole
    assert list(warc.records(iter([]))) == [] and len(list(warc.records(iter([first, first])))) == 2


def test_a_member_is_inflated_as_far_as_it_says(tmp_path):
    import gzip
    import tracemalloc

    bomb = gzip.compress(b"WARC/1.1\r\nContent-Length: 10\r\n\r\n" + b"0" * 200_000_000)
    plain = gzip.compress(b"0" * 200_000_000)
    tracemalloc.start()
    with pytest.raises(ValueError, match="longer or shorter"):
        list(warc.records(iter([bomb])))
    with pytest.raises(ValueError, match="no WARC header"):
        list(warc.records(iter([plain])))
    assert tracemalloc.get_traced_memory()[1] < 20_000_000
    tracemalloc.stop()
    for head in (b"WARC/1.1\r\n\r\n", b"WARC/1.1\r\nContent-Length: -1\r\n\r\n", b"HTTP/1.1\r\nContent-Length: 0\r\n\r\n"):
        with pytest.raises(ValueError, match="no WARC header"):
            list(warc.records(iter([gzip.compress(head + b"\r\n\r\n")])))


def test_warc_sql(spark):
    assert oracle.compare(queries.op10_warc(spark, oracle.SF_DIR), queries.ORACLE_SQL["op10_warc"]) is None


# the whole


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)] + [(7, 7)]
    got = {r.node: r.label for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    assert got == {x: top(x) for e in edges for x in e if e[0] != e[1]}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_queries_by_name():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 14)]
    assert duckdb.connect() is not None
