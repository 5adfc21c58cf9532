"""The memory end to end."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from recollect.api import Memory

TURN = "session_id string, id string, text string, role string, ts_ms long, user_ns string, stability_weight double"


def turns(spark):
    # The same role throughout: every turn is a bundle of its own.
    rows = [("s", f"t{i:02}", f"note {i} about the harbour and the museum visit {i * i}", "user", i * 1000, "u1", 0.5) for i in range(30)]
    rows[3] = ("s", "t03", "Always use the north gate.", "user", 3000, "u1", 0.5)
    return spark.createDataFrame(rows, TURN)


def test_memory(spark, tmp_path):
    m = Memory(spark, f"file://{tmp_path}")
    m.insert_turns(turns(spark))
    assert {r.scope: r.n for r in m.status().collect()} == {"session": 30, "session_raw": 30, "turns": 30}
    m.insert(spark.createDataFrame([("user:u1", "m1", "the harbour museum"), ("user:u10", "m2", "other")], "collection string, id string, text string"))
    q = spark.createDataFrame([(1, "the harbour museum"), (2, "Always use the north gate.")], "query_id long, text string")
    got = {(r.query_id, r["rank"]): r.id for r in m.search(q, ["user:u1", "session:s"], 3).collect()}
    assert got[1, 1] == "m1" and got[2, 1] == "t03" and len(got) == 6
    assert m.search(q, ["user:u1"], 3, spark.createDataFrame([("user:u1", "m1")], "collection string, id string")).count() == 0
    assert m.search_raw(q, "s", 2).count() == 4
    assert {r.id for r in m.ranked(q.where("query_id = 1"), ["user:u1"], 10**6).collect()} == {"m1"}

    result = m.compact(["s"]).collect()
    assert [(r.session_id, r.formed, r.turns_covered) for r in result] == [("s", 1, 19)]  # ten turns fit the tail, one is protected
    assert [r.id for r in m.list_collection("elevated:user:u1").collect()] == ["shard:t03"]
    summary = m.list_collection("session_summary:s").select("id")
    assert summary.count() == 1 and m.expand(summary).count() == 19
    again = {r.id for r in summary.collect()}
    m.compact(["s"])
    assert {r.id for r in m.list_collection("session_summary:s").collect()} == again
    assert m.list_collection("session:s").count() == 30  # compaction deletes nothing

    m.bump_access_counts(spark.createDataFrame([("user:u1", "m1")] * 2, "collection string, id string"))
    assert m.list_collection("user:u1").first().access_count == 1
    g = m.gate(turns(spark).limit(3)).collect()
    assert len(g) == 3 and all(r.r > 0 and 0 <= r.g <= 1 for r in g)
    assert m.export("user").count() == 2
    m.flush_namespace("user:u1", exact=True)
    assert m.list_collection("user:u1").count() == 0 and m.list_collection("user:u10").count() == 1
    m.delete(spark.createDataFrame([("user:u10", "m2")], "collection string, id string"))
    assert m.export("user").count() == 0
    with pytest.raises(ValueError):
        Memory(spark, f"file://{tmp_path}", dims=8).insert(q.select(F.lit("c").alias("collection"), F.col("query_id").cast("string").alias("id"), "text"))


def test_authored_dreams_and_journal(spark, tmp_path):
    m = Memory(spark, f"file://{tmp_path}")
    docs = spark.createDataFrame([("a.md", "- rule one\n- rule two\n\n> quote\n\nplain"), ("b.md", "- b")], "source_doc string, text string")
    m.ingest_markdown(docs)
    m.ingest_markdown(spark.createDataFrame([("a.md", "- only")], "source_doc string, text string"))
    assert [(r.collection, r.id, r.text) for r in m.records().orderBy("id").collect()] == [("authored:hard", "a.md#000000", "only"), ("authored:hard", "b.md#000000", "b")]
    assert m.list_by_meta("authored:hard", "source_doc", "b.md").count() == 1
    m.promote(spark.createDataFrame([("d", 1, "long enough to keep", 0.7, 2, 2), ("d", 2, "x", 0.9, 9, 9)], "source_doc string, line int, text string, score double, recall_count int, unique_queries int"), "u")
    assert [r.id for r in m.list_collection("dream:u").collect()] == ["d#dream#000000"]
    m.hint(spark.createDataFrame([(f"h{i}", i, "s", "start", None) for i in range(9)], "id string, ts_ms long, session_id string, hook string, reason string"), 5)
    assert [r.id for r in m.journal("s", 2).collect()] == ["h4", "h5"]


def test_ingest_marks_each_turn_by_its_own_user(spark, tmp_path):
    m = Memory(spark, f"file://{tmp_path}")
    m.insert(spark.createDataFrame([("user:u1", "m1", "i prefer the harbour"), ("turns:u1", "t1", "i prefer the harbour")], "collection string, id string, text string"))
    rows = [("s", "a", "i prefer the harbour", "user", 1, "u1", 0.5), ("s", "b", "i prefer the harbour", "user", 2, "u2", 0.5), ("s", "c", "noted", "assistant", 3, "u1", 0.2)]
    df = spark.createDataFrame(rows, TURN)
    got = {r.id: r for r in m.gate(df.where("role = 'user'")).collect()}
    assert got["a"].h == pytest.approx(0.0) and got["b"].h == 1.0 and got["a"].d == got["b"].d == pytest.approx(0.4)
    m.ingest(df)
    kept = {r.collection: r for r in m.records().where("id like 'u_:%'").collect()}
    assert set(kept) == {"user:u1", "user:u2"}
    assert float(kept["user:u2"].metadata["gating_h"]) == 1.0 and float(kept["user:u1"].metadata["stability_weight"]) == 0.5
    assert {r.scope: r.n for r in m.status().collect()} == {"session": 3, "session_raw": 3, "turns": 3, "user": 3}
