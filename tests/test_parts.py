"""Sources, commits, file sync, sanitiser, temporal parts and prompt headers on hand-made rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from recollect import plans
from recollect.functions import text as T
from recollect.operators import assemble, commit, evaluate, pack, protect, session, store, temporal
from recollect.sources import files
from recollect.streaming import sync


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_markdown_tree(spark, tmp_path):
    for name, text in {"a.md": "A", "sub/b.markdown": "B", "sub/skip.md": "S", "memory.md": "M", "c.txt": "C"}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(text)
    got = lambda **k: sorted((r.path, r.text) for r in files.markdown(spark, f"file://{tmp_path}", **k).collect())
    assert got() == [("a.md", "A"), ("memory.md", "M"), ("sub/b.markdown", "B"), ("sub/skip.md", "S")]
    assert got(include=["sub/*"], exclude=["*skip*"]) == [("memory.md", "M"), ("sub/b.markdown", "B")]


@pytest.mark.parametrize(("text", "want"), [("---\ntags: x\n---\nbody", True), ("no tags", False), ("with #tag inside", True), ("# heading #tag", False), ("```\n#tag\n```", False), ("---\ntitle: x\n---\n#tag", False), ("a\n~~~\nx\n~~~\nsee #t", True)])
def test_eligible(spark, text, want):
    assert one(spark, files.eligible_note(F.lit(text))) is want


def test_diary(spark):
    text = "\n".join(["# Top", "- x {score=1 recall=3 unique=3}", "## Deep  Sleep", "- keep this {score=0.7, recall=3 unique=2}", "```", "- no {score=1 recall=1 unique=1}", "```", "* other {recallcount=2 uniquequeries=4 score=.5}", "- {score=1 recall=1 unique=1}", "- no end {score=1 recall=1}", "### Other", "- gone {score=1 recall=1 unique=1}", "## Promoted", "+ last {score=1 recall=1 unique=1}"])
    got = files.diary(spark.createDataFrame([("d", text), ("e", None)], "source_doc string, text string")).orderBy("line").collect()
    assert [(r.text, r.score, r.recall_count, r.unique_queries, r.section, r.line) for r in got] == [("keep this", 0.7, 3, 2, "deep sleep", 4), ("other", 0.5, 2, 4, "deep sleep", 8), ("last", 1.0, 1, 1, "promoted", 14)]


def test_instances(spark, tmp_path):
    item = {"question_id": "q", "question_type": "t", "question": "?", "answer": "!", "haystack_session_ids": ["s"], "haystack_sessions": [[{"role": "user", "content": "hi", "has_answer": True}]], "answer_session_ids": ["s"]}
    (tmp_path / "a.json").write_text(json.dumps([item]))
    (tmp_path / "b.json").write_text(json.dumps({"questions": [item, item]}))
    assert files.instances(spark, f"{tmp_path}/a.json").count() == 1
    rows = files.instances(spark, f"{tmp_path}/b.json").collect()
    assert len(rows) == 2 and rows[0].haystack_sessions[0][0].content == "hi"
    (tmp_path / "c.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert files.json_lines(spark, f"{tmp_path}/c.jsonl", "a long").count() == 2


def test_commits(spark, tmp_path):
    s = commit.Store(spark, f"file://{tmp_path}")
    assert s.version() == 0 and s.tables() == {}
    assert s.commit({"a": spark.range(3), "b": spark.range(2)}, 0) == 1
    assert s.commit({"a": spark.range(5)}, 1) == 2
    assert s.read("a").count() == 5 and s.read("b").count() == 2 and s.read("a", 1).count() == 3
    with pytest.raises(commit.Conflict):
        s.commit({"a": spark.range(9)}, 1)
    assert s.read("a").count() == 5


def test_sync(spark):
    files_ = spark.createDataFrame([("a", "- one", 5, 1), ("b", "- two!", 6, 2), ("c", "- new", 5, 3), ("e", "- same", 6, 9)], "path string, text string, size long, mtime_ms long")
    known = spark.createDataFrame([("a", "- one", 5, 1), ("b", "- two", 5, 1), ("d", "- old", 5, 1), ("e", "- same", 6, 8)], files_.schema)
    nodes = sync.synced(known.limit(0).select(F.col("path").alias("source_doc"), "text").transform(lambda d: __import__("recollect.operators.authored", fromlist=["x"]).nodes(d)), known, known.select("path", F.lit("new").alias("change")))
    diff = sync.changes(files_, sync.state(known))
    assert sorted(map(tuple, diff.collect())) == [("b", "changed"), ("c", "new"), ("d", "gone")]
    assert sorted((r.source_doc, r.text) for r in sync.synced(nodes, files_, diff).collect()) == [("a", "one"), ("b", "two!"), ("c", "new"), ("e", "same")]


def test_sanitiser(spark):
    clean = lambda t: one(spark, protect.sanitised(F.lit(t)))
    assert clean("a\n```\n" + "x" * 250 + "\n```\nb") == "a\n[code block left out]\nb"
    assert clean("```\n" + "l\n" * 8 + "```") == "[code block left out]" and clean("```\nshort\n```") == "```\nshort\n```"
    assert clean("data:" + "x y" * 30) == "[encoded data left out]" and clean("A1" * 50) == "[encoded data left out]" and clean("word " * 30) == ("word " * 30).strip()
    assert clean("a\n\n\n\nb") == "a\n\nb" and clean("  \n ") == "[no text]"


def test_temporal_parts(spark):
    assert one(spark, temporal.intent_phrases(F.lit("compare the red bicycle shop with blue"))) == ["compare red bicycle shop", "red bicycle shop blue", "compare red bicycle", "red bicycle shop", "bicycle shop blue", "compare red", "red bicycle", "bicycle shop", "shop blue"]
    assert one(spark, temporal.slots(F.lit("How many days between the harbour visit and my old green museum tour trip?"))) == ["harbour visit", "old green museum tour", "green museum tour trip"]
    assert one(spark, temporal.slots(F.lit("is it"))) == []
    assert one(spark, temporal.side_slots(F.array(F.lit("trip"), F.lit("red boat"), F.lit("blue car")))) == ["red boat", "blue car"]
    assert one(spark, temporal.side_slots(F.array(F.lit("trip"), F.lit("red boat")))) == ["trip", "red boat"]
    assert one(spark, temporal.pastness(F.lit("I went there"))) == 1.0 and one(spark, temporal.pastness(F.lit("I want to go"))) == 0.0
    w = lambda t: one(spark, temporal.witness(F.lit("red boat"), F.lit("blue car"), F.lit(t)))
    assert w("red boat seen near shore today") == pytest.approx(1.0 * 2 / 6)
    assert w("nothing") == 0.0 and w("red boat blue car seen today") < w("red boat xxx yyy seen today")
    assert one(spark, temporal.selector_applies(F.lit(True), F.lit(True), F.lit(True), F.lit(3))) is False and one(spark, temporal.selector_applies(F.lit(True), F.lit(False), F.lit(True), F.lit(3))) is True


def test_greedy(spark):
    rows = [(1, 1, "a", 0.5, ["x"], 2), (1, 2, "b", 0.45, ["x"], 2), (1, 3, "c", 0.4, ["y"], 2), (1, 4, "d", 0.05, [], 2), (2, 1, "e", 0.11, [], 2)]
    df = spark.createDataFrame(rows, "query_id long, pos int, id string, final_score double, covered array<string>, n_slots int")
    got = [(r.query_id, r.id, r.selected) for r in temporal.greedy_fill(df).orderBy("query_id", "rank").collect()]
    assert got == [(1, "a", True), (1, "c", True), (1, "b", True), (1, "d", False), (2, "e", False)]


def test_header(spark):
    rows = [(1, "recalled", 2, "x < y", "user"), (1, "authored", 1, "rule", None), (1, "recalled", 1, "z", "assistant")]
    text = assemble.header(spark.createDataFrame(rows, "query_id long, section string, position int, text string, role string")).first().header
    assert text.startswith("<authored_context>\n") and "[A1] rule" in text and '[M1] <entry speaker="assistant" source="recalled">z</entry>\n[M2] <entry speaker="user" source="recalled">x &lt; y</entry>' in text
    assert text.index("</authored_context>\n\n<recalled_memories>") > 0


def test_miss_counts_take_all_whole_answers(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "MOST_ANSWERS", 3)
    answers = [(1, "The old Harbour is closed now"), (2, "arbo"), (7, "no, no"), (8, None), (9, ""), (500, "quite other words\nwith a tail"), (500, "harbour"), (None, "closed")]
    texts = ["They say: the old harbour is closed nowadays", "closed harbour", None, "", "Quite other words\nwith a tail!", "quite other words", "the old is harbour closed now"]
    a = spark.createDataFrame(answers, "item_id long, answer string")
    t = spark.createDataFrame([(x,) for x in texts], "text string")
    got = {tuple(r) for r in evaluate.miss_counts(a, t).collect()}
    pairs = a.crossJoin(t).select("item_id", evaluate.miss_class(F.col("answer"), F.col("text")).alias("miss"))
    assert got == {tuple(r) for r in pairs.groupBy("item_id", "miss").agg(F.count("*")).collect()}
    assert evaluate.miss_counts(a.limit(0), t).count() == evaluate.miss_counts(a, t.limit(0)).count() == 0


def test_miss_classes_leave_no_ids_out(spark, tmp_path):
    spark.range(2000).withColumnRenamed("id", "doc_id").withColumn("text", F.concat(F.lit("word"), F.col("doc_id").cast("string"))).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, f"word{i}") for i in range(0, 2000, 100)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.item_id, r.miss): r.n for r in plans.QUERIES["e6_miss_classes"](spark, str(tmp_path)).collect()}
    assert {i for i, _ in got} == set(range(0, 2000, 100)) and got[1900, "answer_present"] == 1 and got[1900, "none"] == 1999


def test_long_prior_context_keeps_what_can_still_fit(spark):
    """The pass over a session gives what a look at all earlier summaries gives."""
    rng = __import__("random").Random(4)
    given = [(s, rng.randrange(0, 400), f"i{k:04}", f"t{s}-{k}", rng.choice([1, 2, 3, 5, 20, 60, 96, 97, 200])) for s in range(3) for k in range(500)]
    starts = [(s, b, rng.randrange(0, 420)) for s in range(4) for b in range(60)]
    got = session.prior_context(spark.createDataFrame(starts, "session_id int, bucket long, start_ms long"), spark.createDataFrame(given, "session_id int, ts_ms long, id string, text string, tokens long")).collect()
    want = []
    for s, b, at in starts:
        before = sorted((x for x in given if x[0] == s and x[1] < at), key=lambda x: (-x[1], x[2]))
        used, texts = 0, []
        for x in before:
            if used + x[4] <= 96:
                used += x[4]
                texts.insert(0, x[3])
        if before:
            want.append((s, b, used, "\n\n".join(texts)))
    assert sorted(map(tuple, got)) == sorted(want)


def test_windows_and_pooled_vectors(spark):
    words = [f"w{i}" for i in range(700)]
    df = spark.createDataFrame([(n, " ".join(words[:n])) for n in (1, 256, 257, 512, 513, 700)], "id int, text string")
    got = {(r.id, r.start): r.words for r in session.token_windows(df, "id").collect()}
    assert got == {(n, s): words[s : min(n, s + 512)] for n, starts in ((1, [0]), (256, [0]), (257, [0]), (512, [0]), (513, [0, 256]), (700, [0, 256])) for s in starts}
    pooled = {r.id: (r.vector, r.n) for r in session.pooled(df, "id", lambda t: F.array(F.length(t).cast("double"), F.lit(1.0)), 2).collect()}
    assert pooled[700] == ([(len(" ".join(words[:512])) + len(" ".join(words[256:700]))) / 2, 1.0], 2)


def test_fnv64(spark):
    def fnv(data: bytes) -> str:
        h = 0xCBF29CE484222325
        for b in data:
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        return f"{h:016x}"

    texts = ["", "a", "foobar", "é漢😀", "x" * 1000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(T.fnv64(F.col("t"))).collect()] == [fnv(t.encode()) for t in texts]
    assert fnv(b"a") == "af63dc4c8601ec8c"


def test_startup_reserve_and_speakers(spark):
    costs = spark.createDataFrame([(1, 10), (1, 20), (2, 5)], "query_id int, tokens int")
    assert sorted(map(tuple, pack.reserve_checked(costs, 30).collect())) == [(1, 30), (2, 5)]
    with pytest.raises(Exception, match="startup reserve"):
        pack.reserve_checked(costs, 29).collect()
    rows = [(1, "recalled", 1, "hi", None, "user:u1", None), (1, "recalled", 2, "ho", None, "global", None), (1, "recalled", 3, "he", "assistant", "session:s", None), (1, "recalled", 4, "ha", None, "global", "u2")]
    h = assemble.header(spark.createDataFrame(rows, "query_id int, section string, position int, text string, role string, collection string, user_id string")).first().header
    assert [line.split('"')[1] for line in h.split("\n") if "<entry" in line] == ["user", "unknown", "assistant", "user"]


def test_failures_in_common(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "query_id int")
    assert tuple(evaluate.failure_jaccard(ids(1, 2, 2), ids(2, 3)).first()) == (2, 2, 1, pytest.approx(1 / 3))
    assert tuple(evaluate.failure_jaccard(ids(), ids()).first()) == (0, 0, 0, 1.0)


def test_authored_nodes_are_replaced_in_all_tiers(spark):
    schema = "collection string, source_doc string, id string"
    records = spark.createDataFrame([("authored:hard", "a", "a#000000"), ("authored:variant", "a", "a#000001"), ("authored:soft", "b", "b#000000"), ("user:u", "a", "x"), ("user:u", None, "y")], schema)
    new = spark.createDataFrame([("authored:soft", "a", "a#000000")], schema)
    got = store.authored_replaced(records, spark.createDataFrame([("a",), ("a",)], "source_doc string"), new)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("authored:soft", "b", "b#000000"), ("user:u", "a", "x"), ("user:u", None, "y"), ("authored:soft", "a", "a#000000")], key=repr)
    assert sorted(r.id for r in store.without_collections(records, "authored:").collect()) == ["x", "y"] and store.without_collections(records, "").count() == 5
