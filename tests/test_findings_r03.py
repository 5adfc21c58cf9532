"""What the third review found."""

from __future__ import annotations

import random

import numpy as np
import oracle
from pyspark.sql import functions as F

from recollect import plans
from recollect.llm import common, ngram_join
from recollect.operators import retrieve, session, temporal


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def talk(spark, folder, said: list[tuple]) -> str:
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def test_a_turn_of_then_alone_has_the_slots_of_the_sql(spark, tmp_path):
    d = talk(spark, tmp_path, [(1, 0, "user", "And then of in."), (2, 0, "user", "red boat and then the old harbour"), (3, 0, "user", None), (4, 0, "user", "")])
    assert oracle.compare(plans.QUERIES["c13_slots"](spark, d), plans.ORACLE_SQL["c13_slots"], d) is None
    assert one(spark, temporal.slots(F.lit("And then of in."))) == ["then"] and one(spark, temporal.slots(F.lit("And then of in."), fallback=False)) == []


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tails_are_those_of_each_query_and_windows_are_by_session(spark):
    rng = random.Random(3)
    turns = [(s, f"t{s}{i:03}", i // 2, rng.choice(["user", "assistant", "user", "system"]), rng.randint(0, 30)) for s in range(4) for i in range(60 if s else 3)]
    asked = [(q, q % 6, rng.choice([0, 15, 40, 90, 400]), rng.random() < 0.3) for q in range(40)]  # two of the sessions have no turns
    t = spark.createDataFrame(turns, "session_id long, id string, ts_ms long, role string, tokens long")
    q = spark.createDataFrame(asked, "query_id long, session_id long, room long, base_only boolean")
    got = session.tails(q, t)
    assert "query_id" not in "".join(line for line in plan(got).splitlines() if "Window" in line)
    one_each = q.join(t, "session_id").drop("session_id").withColumnRenamed("query_id", "session_id")
    want = session.tail_split(one_each, 4, F.col("room")).where(F.when(F.col("base_only"), F.col("in_base")).otherwise(F.col("recent")))
    rows = lambda df, key: sorted((r[key], r.id, r.in_base, r.tokens) for r in df.collect())
    assert rows(got, "query_id") == rows(want, "session_id")


def test_ties_are_cut_at_once(spark):
    score = np.array([[0.5] * 1000, [0.1] * 500 + [0.9] * 2 + [0.1 + 1e-12] * 498, [-np.inf] * 999 + [0.2]])
    row, col = retrieve._best(score, 3)
    assert sorted(zip(row.tolist(), col.tolist(), strict=True)) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 500), (1, 501), (2, 999)]


def test_large_groups_share_no_cell(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "RECORD_TILE", 32)
    monkeypatch.setattr(retrieve, "QUERY_TILE", 32)
    r = spark.createDataFrame([(i, "c", i % 20) for i in range(600)], "id long, collection string, within long")
    q = r.select(F.col("id").alias("query_id"), "within")
    for side, by in zip(retrieve._cells(r, q, 600)[:2], ("query_id", "id"), strict=True):
        assert side.groupBy("_cell", "_g", "_h").agg(F.count(by).alias("n")).agg(F.max("n")).first()[0] <= 32


def test_vectors_that_are_no_numbers_take_no_place(spark):
    r = spark.createDataFrame([(1, "c", [1.0, 0.0]), (2, "c", [float("nan"), 1.0]), (3, "c", [0.0, 1.0]), (4, "c", [float("inf"), 1.0])], "id long, collection string, vector array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.2])], "query_id long, vector array<double>")
    assert [(x.id, x["rank"]) for x in retrieve.top_k(r, q, 2).orderBy("rank").collect()] == [(1, 1), (3, 2)]


def test_terms_are_made_once_a_text(spark, tmp_path):
    d = talk(spark, tmp_path, [(1, 0, "user", "I'm planning a harbour trip"), (1, 1, "assistant", "We went to the old museum"), (1, 2, "user", "Über the red Boat_1 and 2x harbour"), (2, 0, "user", "")])
    for name in ("c18_witness", "c8_raw_recovery_all"):
        assert oracle.compare(plans.QUERIES[name](spark, d), plans.ORACLE_SQL[name], d) is None
    spark.createDataFrame([(1, "The und der than"), (2, ""), (3, None), (4, "QUE's les-die der")], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    for name in ("c14_slot_coverage", "f2_terms"):
        df = plans.QUERIES[name](spark, d)
        assert oracle.compare(df, plans.ORACLE_SQL[name], d) is None
        assert "split(" not in plan(df)
    assert plan(plans.QUERIES["c14_slot_coverage"](spark, d)).count("lower(") == 1
    joined = plan(plans.QUERIES["c8_raw_recovery_all"](spark, d))
    assert "lower(" not in joined[: joined.index("Join")]
    assert plan(plans.QUERIES["c18_witness"](spark, d)).count("harbour trip") <= 3


def test_sets_of_large_buckets_go_down_without_a_salted_join(spark, monkeypatch):
    """op7_ngram_join: the largest buckets are told by a list; with room for few in it, or none, the leaves are the same."""
    rng = np.random.default_rng(4)
    core = rng.integers(0, 1 << 32, 128, np.uint32)
    rows = [(i, np.where(rng.random(128) < 0.9, core, rng.integers(0, 1 << 32, 128, np.uint32)).astype("<u4").tobytes()) for i in range(300)]
    rows += [(i, np.where(np.arange(128) < 100, i // 3, rng.integers(0, 1 << 32, 128, np.uint32)).astype("<u4").tobytes()) for i in range(300, 390)]
    sets = spark.createDataFrame(rows, "id long, sketch binary").repartition(5, "id").localCheckpoint()
    found = ngram_join.leaves(sets)
    assert "_salt" not in plan(found)
    leaves = sorted(map(tuple, found.collect()))
    assert max(n for *_, n in leaves) > ngram_join.SMALL and len({i for i, *_ in leaves}) == 390
    for keys in (1, 3):
        monkeypatch.setattr(common, "HOT_KEYS", keys)
        assert sorted(map(tuple, ngram_join.leaves(sets).collect())) == leaves


def test_texts_of_one_row_group_are_searched_by_many_tasks(spark, tmp_path):
    """F8: f2_terms read and searched such a table in a single task."""
    said = [(i, f"Red_boat {i} of the x harbour, the Harbour {'z' * (i % 5)} é") for i in range(400)] + [(400, ""), (401, None), (402, " ?! ")]
    spark.createDataFrame(said, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = plans.QUERIES["f2_terms"](spark, str(tmp_path))
        assert oracle.compare(got, plans.ORACLE_SQL["f2_terms"], str(tmp_path)) is None
        assert min(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()) < 200
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
