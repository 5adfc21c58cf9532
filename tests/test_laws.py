"""Laws of the operators on hand-made rows: every threshold from both sides, and properties that must always hold."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from recollect import model
from recollect.functions import text as T
from recollect.functions import vector as V
from recollect.operators import authored, compact, gate, modality, pack, rank, retrieve, session, store

NOW = 1_000_000_000


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_token_estimates(spark):
    rows = [("",), ("abcde",), ("漢字漢",), ("привет",), ("😀😀",)]
    t = F.col("t")
    assert values(spark, rows, "t string", T.tokens_packed(t), T.tokens_floor(t), T.tokens_ceil(t)) == [(0, 1, 1), (2, 1, 2), (2, 1, 1), (3, 1, 2), (1, 1, 1)]


def test_ascii_borders(spark):
    rows = [("éa b",), ("a",), ("xa",)]
    assert values(spark, rows, "t string", T.matches(F.col("t"), r"\ba\b")) == [(True,), (True,), (False,)]


def test_cosine_and_prefix(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([], [])]
    assert [r[0] for r in values(spark, rows, "a array<double>, b array<double>", V.cosine(F.col("a"), F.col("b")))] == [1.0, 0.0, 0.0, 0.0]
    (out,) = values(spark, [([3.0, 4.0, 9.0],)], "a array<double>", V.prefix(F.col("a"), 2))
    assert out[0] == [0.6, 0.8]


def test_top_k_excludes_without_losing_places(spark):
    rows = [(i, [1.0, i / 10], "a" if i % 2 else "b") for i in range(10)]
    v = spark.createDataFrame(rows, "id long, vector array<double>, collection string")
    q = v.where("id = 0").select(F.col("id").alias("query_id"), "vector")
    assert [r.id for r in retrieve.top_k(v, q, 3).orderBy("rank").collect()] == [1, 2, 3]
    assert retrieve.top_k(v, q, 0).count() == 9
    assert [r.id for r in retrieve.top_k_over_collections(v, q, 3).orderBy("rank").collect()] == [1, 2, 3]
    assert retrieve.top_k(v, q.limit(0), 3).count() == 0
    many = retrieve.top_k(v, v.select(F.col("id").alias("query_id"), "vector"), 2).collect()
    for i in range(10):  # many queries at once give what each gives alone
        one = retrieve.top_k(v, v.where(F.col("id") == i).select(F.col("id").alias("query_id"), "vector"), 2).collect()
        assert sorted((r.rank, r.id, round(r.score, 9)) for r in one) == sorted((r.rank, r.id, round(r.score, 9)) for r in many if r.query_id == i)


@pytest.mark.parametrize(("best", "tier"), [(0.65, 1), (0.6499, 2), (0.3, 3)])
def test_cascade_exits(spark, best, tier):
    # The first prefix has cosine ``best``, the second reaches 0.75 unless the third is wanted.
    side = (1 - best**2) ** 0.5
    v = spark.createDataFrame([(1, [best, side, 10.0 if tier == 2 else 0.0, 0.0], "c")], "id long, vector array<double>, collection string")
    q = spark.createDataFrame([(0, [1.0, 0.0, 10.0 if tier == 2 else 0.0, 0.0])], "query_id long, vector array<double>")
    assert [r.tier for r in retrieve.cascade(v, q, (2, 3, 4)).collect()] == [tier]


CAND = "query_id long, collection string, id long, score double, access_count long, authority double, authored boolean, ts_ms long, type string, decay_rate double, scope string"


def candidate(i, score, **more):
    row = {"query_id": 1, "collection": "c", "id": i, "score": score, "access_count": None, "authority": None, "authored": None, "ts_ms": None, "type": "turn", "decay_rate": None, "scope": "global"} | more
    return tuple(row.values())


def test_hybrid(spark):
    df = spark.createDataFrame([candidate(1, 1.0, scope="session"), candidate(2, -1.0), candidate(3, 1.0, type="summary", decay_rate=1.0, scope="user"), candidate(4, 0.0, ts_ms=NOW - 100_000_000)], CAND)
    got = {r.id: r.final_score for r in rank.hybrid(df, NOW).collect()}
    assert got[1] == pytest.approx(1.0) and got[2] == pytest.approx(0.23) and got[3] == pytest.approx(0.48)
    assert got[4] == pytest.approx(0.2 * 2.718281828 ** (-0.2) + 0.03)
    assert rank.hybrid(df, NOW, 0, 0, 0).where("id = 1").first().final_score == pytest.approx(1.0)


def test_two_pass_takes_counts_of_survivors(spark):
    df = spark.createDataFrame([candidate(1, 0.2, access_count=3), candidate(2, 0.1999999, access_count=1000), candidate(3, 0.9, authored=True), candidate(3, 0.9, authored=True)], CAND)
    got = {r.id: (r.omega, r.final_score) for r in rank.two_pass(df, NOW).collect()}
    assert set(got) == {1, 3}
    import math

    assert got[1][0] == pytest.approx(0.5 + 0.2 * math.log(4) / math.log(5)) and got[3] == pytest.approx((0.8, 0.8 * 0.9 / 1.3))


def test_hops_and_merge(spark):
    ranked = spark.createDataFrame([(1, 10, 0.3), (1, 11, 0.29), (1, 12, 0.8)], "query_id long, id long, final_score double")
    links = spark.createDataFrame([(10, 20), (11, 21), (12, 20), (12, 10)], "id long, target long")
    hops = rank.hops(ranked, links)
    assert [tuple(r) for r in hops.collect()] == [(1, 20, 0.4)]
    assert [tuple(r) for r in rank.hops(ranked.where("id = 10"), links).collect()] == [(1, 20, 0.15)]
    assert rank.hops(ranked.where("id = 11"), links).count() == 0
    both = rank.merged(ranked, spark.createDataFrame([(1, 10, 0.9), (1, 12, 0.8)], "query_id long, id long, final_score double"))
    assert {r.id: (r.final_score, r.hop) for r in both.collect()} == {10: (0.9, 1), 11: (0.29, 0), 12: (0.8, 0)}


@pytest.mark.parametrize(("rows", "fired"), [
    ([(1, 0.1499, "turn", None, 3)], True), ([(1, 0.15, "turn", None, 3)], False), ([(1, 0.1, "turn", None, 2)], False),
    ([(i, 0.9, "summary", 0.49, 1) for i in range(1, 5)], True), ([(i, 0.9, "summary", 0.5, 1) for i in range(1, 5)], False),
    ([(i, 0.9, "summary", None, 1) for i in range(1, 4)], False),
])
def test_failure_detector(spark, rows, fired):
    df = spark.createDataFrame([(1, *r) for r in rows], "query_id long, rank int, final_score double, type string, confidence double, cascade_tier int")
    assert rank.retrieval_failed(df).first().fired is fired


def test_fits(spark):
    rng = random.Random(1)
    rows = [(q, r, str(r), rng.randrange(1, 60)) for q in range(30) for r in range(8)]
    df = spark.createDataFrame(rows, "query_id long, rank int, id string, tokens long")
    prefix, first = pack.prefix_fit(df, 100).collect(), pack.first_fit(df, 100).collect()
    for q in range(30):
        used, want_prefix, total, want_first = 0, [], 0, []
        stopped = False
        for _, r, i, c in [x for x in rows if x[0] == q]:
            stopped |= used + c > 100
            if not stopped:
                used += c
                want_prefix.append(i)
            if total + c <= 100:
                total += c
                want_first.append(i)
        assert [r.id for r in sorted(prefix, key=lambda r: r.rank) if r.query_id == q] == want_prefix
        assert [r.id for r in sorted(first, key=lambda r: r.position) if r.query_id == q] == want_first


def test_tail_and_buckets(spark):
    rng = random.Random(2)
    rows = [(s, f"{i:03}", rng.choice(["user", "assistant", "system"]), i, rng.randrange(1, 60), "t") for s in range(20) for i in range(rng.randrange(1, 60))]
    df = spark.createDataFrame(rows, "session_id long, id string, role string, ts_ms long, tokens long, text string")
    got = session.tail_split(df, 4, 128).collect()
    for s in range(20):
        mine = [r for r in rows if r[0] == s]
        at = max(0, len(mine) - 4)
        used = sum(r[4] for r in mine[at:])
        while used <= 128 and at > 0 and used + mine[at - 1][4] <= 128:
            at -= 1
            used += mine[at][4]
        while at > 0 and {mine[at][2], mine[at - 1][2]} == {"user", "assistant"}:
            at -= 1
        assert sorted(r.id for r in got if r.session_id == s and r.recent) == [r[1] for r in mine[at:]]
        parts = [r.bucket for r in sorted(session.buckets(df.where(F.col("session_id") == s)).collect(), key=lambda r: r.id)] if s < 3 else [0]
        assert parts == sorted(parts) and set(parts) == set(range(max(parts) + 1)) if s < 3 else True


def test_gate(spark):
    rows = [("a", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), ("b", 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), ("c", 0.0, 1.0, 0.0, 0.0, 0.35, 1.0, 0.0), ("d", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id string, h double, r double, t double, d double, p double, a double, dtech double")
    got = {r.id: (round(r.g, 6), r.passes) for r in gate.gated(df).collect()}
    assert got == {"a": (0.0, False), "b": (0.35, True), "c": (0.4, True), "d": (1.0, True)}
    hits = spark.createDataFrame([("x", "turn", 1, 0.8), ("x", "turn", 2, 0.7999), ("x", "memory", 1, 0.85), ("x", "memory", 2, -0.5), ("y", "turn", 1, 0.0)], "id string, kind string, rank int, score double")
    out = {r.id: (r.h, r.r) for r in gate.from_hits(hits).collect()}
    assert out["x"] == pytest.approx((1 - 0.425, 0.2 * (1 - 1 / 3))) and out["y"] == (1.0, 0.0)


def test_budgets(spark):
    df = spark.createDataFrame([(1, 4000.0, 100.0, 50.0, True, True), (2, 400.0, 90.0, 20.0, True, False), (3, 40.0, 0.0, 0.0, True, False)], "query_id long, budget double, hard double, tail_base double, fired boolean, comparison boolean")
    got = {r.query_id: (r.degraded, r.soft, r.retrieval, r.elevated, r.reserve) for r in pack.budgets(df).collect()}
    assert got == {1: (False, 300.0, 550.0, 150.0, 180.0), 2: (True, 0.0, 0.0, 0.0, 16.0), 3: (False, 3.0, 7.0, 1.5, 10.0)}


@pytest.mark.parametrize(("text", "mask"), [
    ("You must not share this.", 4), ("you really should answer", 2), ("You may leave. ", 8), ("you may not leave", 4), ("you can not", 4), ("you must imagine it", 0), ("you must to imagine it", 0),
    ("Always use tabs", 2), ("do not delete it", 4), ("never run it", 4), ("No exceptions", 4), ("No", 0), ("Don't forget it", 2), ("The code must work", 0), ("Code must work", 2), ("the system must work", 2), ("Code should be validated", 0), ("Code should be validate", 2),
    ("ALLOC STRATEGY: arena", 2), ("alloc strategy: arena", 0), ("ON FAIL -> stop", 2), ("build: make all", 2), ("unit test", 0), ("lint step: go", 2), ("Every change must pass", 2), ("Default requirement: every x", 2),
    ("If it fails, do not rerun", 4), ("if it fails, make sure to rerun", 2), ("if it fails then rerun", 0), ("in the folder, run them", 0), ("in the folder,run them", 2), ("nice but keep it", 2),
    ("to get it going just check it", 2), ("to get it going. We check it", 0), ("the tests are here and don't change it", 6), ("The design goal is: preserve rules", 0), ("You are a helper", 2), ("then we use it", 0), ("", 0), (None, 0),
])
def test_modality(spark, text, mask):
    assert values(spark, [(text,)], "t string", modality.mask(F.col("t"))) == [(mask,)]


def test_nodes(spark):
    text = "---\nhop_targets: [a, 'b', a]\ntitle: x\n---\n# Head #\n\nSome text\nover lines\n\n- always use it\n  nested\n- second\n\n> quoted\nlazily\n\n```\n# code\n\n- no item\n```\n\nYou must do it\n\n    indented code\n"
    got = authored.nodes(spark.createDataFrame([("d", text), ("e", None), ("f", "plain")], "source_doc string, text string")).orderBy("source_doc", "ordinal").collect()
    assert [(r.kind, r.tier, r.text) for r in got if r.source_doc == "d"] == [
        ("frontmatter", 1, "hop_targets: [a, 'b', a]\ntitle: x"), ("heading", 0, "Head"), ("paragraph", 0, "Some text over lines"), ("list", 1, "always use it nested"), ("list", 1, "second"),
        ("blockquote", 2, "quoted lazily"), ("code", 0, "# code\n\n- no item"), ("paragraph", 2, "You must do it"), ("code", 0, "indented code"),
    ]
    assert [r.hop_targets for r in got if r.source_doc == "d"][1] == ["a", "b"] and [r.ordinal for r in got if r.source_doc == "d"] == list(range(9))
    assert all(text.encode()[r.position :].lstrip(b"#>- `\n").startswith(r.text.split("\n")[0].split(" ")[0].lstrip("# ").encode()) for r in got if r.source_doc == "d" and r.kind in ("heading", "paragraph", "list"))
    assert [(r.kind, r.text) for r in got if r.source_doc == "f"] == [("paragraph", "plain")]


def test_store(spark):
    records = spark.createDataFrame([("user:u1", "a", 1), ("user:u10", "b", None), ("user:u2", "c", 0)], "collection string, id string, access_count long")
    assert sorted(r.id for r in store.flushed(records, "user:u1").collect()) == ["c"]
    assert sorted(r.id for r in store.flushed(records, "user:u1", exact=True).collect()) == ["b", "c"]
    with pytest.raises(ValueError):
        store.flushed(records, "user:")
    used = spark.createDataFrame([("user:u1", "a"), ("user:u1", "a"), ("user:u10", "b"), ("x", "")], "collection string, id string")
    assert {r.id: r.access_count for r in store.bumped(records, used).collect()} == {"a": 2, "b": 1, "c": 0}
    diary = spark.createDataFrame([("d", 3, "sixteen bytes ok", 0.6, 2, 2), ("d", 1, " fifteen bytes!! ", 0.6, 2, 2), ("d", 9, "sixteen bytes ok", 0.59, 2, 2), ("d", 8, "sixteen bytes ok", 0.9, 1, 2), ("d", 7, None, 0.9, 2, 2), ("d", 5, "sixteen bytes too", 0.9, 3, 2)], "source_doc string, line int, text string, score double, recall_count int, unique_queries int")
    assert sorted((r.id, r.line) for r in store.promoted(diary).collect()) == [("d#dream#000000", 3), ("d#dream#000001", 5)]
    with pytest.raises(Exception, match="another dimension"):
        store.checked(spark.createDataFrame([([1.0],)], "vector array<double>"), 2).collect()


def test_namespace(spark):
    rows = [("u", "s", "a", "f"), (" ", "s", "a", "f"), (None, "", "a", "f"), (None, None, None, "f"), (None, None, None, " ")]
    got = values(spark, rows, "u string, s string, a string, f string", model.namespace(*map(F.col, "usaf")))
    assert [r[0] for r in got] == ["u", "session-key:s", "agent-id:a", "f", "default"]


def test_expansion_follows_summaries_to_turns(spark):
    edges = spark.createDataFrame([("a", "b", "summary"), ("a", "t1", "turn"), ("b", "c", "summary"), ("b", "t2", None), ("c", "a", "summary"), ("c", "t3", "turn")], "parent_summary_id string, child_id string, child_type string")
    below = lambda depth: sorted((r.child_id, r.depth) for r in compact.expanded(edges, spark.createDataFrame([("a",)], "id string"), depth).collect())
    assert below(3) == [("a", 3), ("t1", 1), ("t2", 2), ("t3", 3)]  # a comes as what is left at the last depth
    assert below(1) == [("b", 1), ("t1", 1)]


# Expected values below were worked out by hand from the described patterns, not by running them.
@pytest.mark.parametrize(("text", "want"), [
    ("we use git in this class", {"t": 0.8 / 1.5, "dtech": 0.4, "a": 0.0}),
    ("edit src/app please", {"t": 0.7 / 1.5, "p": 1.0}),  # a path and, within it, an endpoint, and "edit" counts as an error code
    ("GET /health now", {"t": 0.3 / 1.5, "p": 0.3}),
    ("I prefer tea and I live in Rome", {"t": 0.0, "d": 0.7}),
    ("use maps or sets instead", {"a": 0.5}),
    ("use maps\ninstead", {"a": 0.0}),
    ("map[string]int", {"dtech": 0.3}),
    ("map[ ]", {"dtech": 0.0}),
    ("panic: x", {"t": 0.0}),
    ("panic:x", {"t": 0.5 / 1.5}),
    ("my friend bo is 12", {"d": 0.5}),
    ("  ", {"t": 0.0, "d": 0.0, "p": 0.0, "a": 0.0, "dtech": 0.0}),
    (None, {"t": 0.0, "p": 0.0}),
])
def test_gate_signals(spark, text, want):
    got = gate.signals(spark.createDataFrame([(text,)], "text string")).first().asDict()
    assert {k: got[k] for k in want} == pytest.approx(want)


@pytest.mark.parametrize(("text", "indicator", "density"), [
    ("how many weeks", 0.0, 0.0), ("how  many days", 1 / 1.5, 0.0), ("met on Jan 5", 0.0, 1 / 3), ("last night", 0.0, 1 / 3), ("midweek", 0.0, 1 / 3), ("tonight, this week", 0.0, 0.0),
    ("Sept 3rd, 2021", 0.0, 2 / 3), ("how long since", 1.0, 0.0), ("today Today", 0.0, 1 / 3),
])
def test_temporal_signals(spark, text, indicator, density):
    r = spark.createDataFrame([(text,)], "text string").select(rank.temporal_indicator(F.col("text")), rank.anchor_density(F.col("text"))).first()
    assert tuple(r) == pytest.approx((indicator, density))


def test_first_candidate_counts(spark):
    rows = [(1, "c", "a", 0.3, 0), (1, "c", "a", 0.9, 1), (1, "c", "b", 0.5, 2)]
    df = spark.createDataFrame(rows, "query_id long, collection string, id string, score double, position int").selectExpr("*", "cast(null as long) as ts_ms", "0L as access_count", "1.0D as authority", "false as authored")
    assert [r.id for r in rank.two_pass(df, 0).orderBy("rank").collect()] == ["b", "a"]
    assert [r.id for r in rank.two_pass(df.drop("position"), 0).orderBy("rank").collect()] == ["a", "b"]


def test_vector_means(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 6.0], [9.0, 9.0]], [True, True, None])], "v array<array<double>>, m array<boolean>")
    r = df.select(V.mean(F.col("v")), V.masked_mean(F.col("v"), F.col("m")), V.masked_mean(F.col("v"), F.array(F.lit(False)))).first()
    assert [list(x) for x in r] == [[13 / 3, 17 / 3], [2.0, 4.0], [0.0, 0.0]]
