"""Search by tiles, within groups, as of a time, with excludes, and by the inverted file, against brute force."""

from __future__ import annotations

import random

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from recollect import model, plans
from recollect.functions import vector as V
from recollect.operators import gate, index, retrieve

RECORDS = "id string, collection string, vector array<double>, user_ns string, ts_ms long"


def rows(n: int, seed: int, users: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        v = [float(rng.randint(-2, 2)) for _ in range(4)]  # few values: many ties, some zero vectors
        user = "u0" if rng.random() < 0.5 else rng.choice([None, *(f"u{k}" for k in range(users))])
        out.append((f"r{i:03}", f"c{rng.randint(0, 2)}", v, user, None if rng.random() < 0.05 else rng.randint(0, 40)))
    return out


def cosine(a, b) -> float:
    n = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(np.dot(a, b)) / n if n else 0.0


def brute(records, queries, k, per_collection=False, exclude_self=True, excluded=(), within=False, order=None) -> list[tuple]:
    out = []
    for q in queries:
        met = [(-round(cosine(q[2], r[2]), 9), r[0], r[1]) for r in records if not (exclude_self and r[0] == q[0]) and (q[0], r[1], r[0]) not in excluded and (not within or (q[3] is not None and q[3] == r[3])) and (not order or (None not in (q[4], r[4]) and (r[4] <= q[4] if order == "<=" else r[4] < q[4])))]
        for c in sorted({m[2] for m in met}) if per_collection else [None]:
            best = sorted(m for m in met if c in (None, m[2]))
            out += [(q[0], i, m[1], m[2], round(-m[0], 6) + 0.0) for i, m in enumerate(best[:k] if k > 0 else best, 1)]
    return sorted(out)


def got(df) -> list[tuple]:
    return sorted((r.query_id, r["rank"], r.id, r.collection, round(r.score, 6) + 0.0) for r in df.collect())


@pytest.fixture
def tiles(monkeypatch):
    monkeypatch.setattr(retrieve, "QUERIES_AT_ONCE", 5)
    monkeypatch.setattr(retrieve, "QUERY_TILE", 7)
    monkeypatch.setattr(retrieve, "RECORD_TILE", 13)
    monkeypatch.setattr(retrieve, "SCORES", 40)


@pytest.mark.parametrize("k", [1, 4, 0])
@pytest.mark.parametrize("per_collection", [False, True])
def test_tiles_are_brute_force(spark, tiles, k, per_collection):
    data = rows(60, k)
    df = spark.createDataFrame(data, RECORDS).repartition(3)
    excluded = [(q[0], r[1], r[0]) for q in data[::3] for r in data[::4]]
    q = df.withColumnRenamed("id", "query_id")
    ex = spark.createDataFrame(excluded, "query_id string, collection string, id string")
    assert got(retrieve.top_k(df, q, k, per_collection, excluded=ex)) == brute(data, data, k, per_collection, excluded=set(excluded))


@pytest.mark.parametrize("order", ["<=", "<"])
def test_groups_and_times_are_brute_force(spark, tiles, order):
    data = rows(80, 9)
    df = spark.createDataFrame(data, RECORDS).repartition(3)
    found = retrieve.top_k(df, df.withColumnRenamed("id", "query_id"), 3, exclude_self=False, within="user_ns", as_of=("ts_ms", order))
    assert got(found) == brute(data, data, 3, exclude_self=False, within=True, order=order)


def test_few_queries_and_many_give_the_same(spark, monkeypatch):
    data = rows(50, 4)
    df = spark.createDataFrame(data, RECORDS).repartition(3)
    q = df.withColumnRenamed("id", "query_id").limit(9)
    few = got(retrieve.top_k(df, q, 3))
    monkeypatch.setattr(retrieve, "QUERIES_AT_ONCE", 2)
    assert got(retrieve.top_k(df, q, 3)) == few == brute(data, [r for r in data if r[0] in {x[0] for x in few}], 3)


def test_searches_of_nothing(spark, tiles):
    df = spark.createDataFrame(rows(20, 1), RECORDS)
    none = spark.createDataFrame([], RECORDS)
    for records, queries in ((df, none), (none, df), (none, none)):
        q = queries.withColumnRenamed("id", "query_id")
        assert retrieve.top_k(records, q, 3).count() == 0
        assert retrieve.top_k(records, q, 3, within="user_ns").count() == 0


@pytest.mark.parametrize("name", ["r1_topk_cosine", "r3_multi_collection", "r3_search_with_excludes", "r4_prefix_cascade", "r1_all_against_all", "g9_gate_as_of"])
def test_tiles_against_sql(spark, monkeypatch, name):
    monkeypatch.setattr(retrieve, "QUERIES_AT_ONCE", 3)
    monkeypatch.setattr(retrieve, "QUERY_TILE", 11)
    monkeypatch.setattr(retrieve, "RECORD_TILE", 100)
    assert oracle.compare(plans.QUERIES[name](spark, oracle.SF_DIR), plans.ORACLE_SQL[name]) is None


def test_a_turn_is_gated_after_it_was_indexed(spark):
    said = [("a", "u1", 1, [1.0, 0.0]), ("b", "u1", 2, [1.0, 0.0]), ("c", "u2", 3, [1.0, 0.0]), ("d", "u1", 4, [0.0, 1.0])]
    df = spark.createDataFrame([(i, u, t, v, "text") for i, u, t, v in said], "id string, user_ns string, ts_ms long, vector array<double>, text string")
    r = {x.id: (x.h, x.r) for x in gate.scored_as_of(df, df, df).collect()}
    # a finds itself only; b finds itself and a, and a as memory; c knows nothing of u1; d is new.
    assert r == {"a": (1.0, 0.2), "b": (0.0, pytest.approx(0.4 * (1 - 1 / 3))), "c": (1.0, 0.2), "d": (1.0, 0.2)}


def test_inverted_file(spark):
    v = model.vectors(spark, oracle.SF_DIR)
    q = v.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    fitted = index.fit(v, 16)
    listed = index.indexed(v, fitted)
    vectors = {r.id: np.array(r.vector) for r in v.collect()}
    assert {r.id: r.list for r in listed.collect()} == {i: int((fitted.centroids @ (x / np.linalg.norm(x))).argmax()) for i, x in vectors.items()}
    exact = retrieve.top_k(v, q, 10)
    share = index.recall(index.search(listed, fitted, q, 10), exact).agg(F.sum("hits") / F.sum("wanted")).first()[0]
    assert share >= 0.9 and fitted.probes < 16
    everything = index.search(listed, fitted, q, 10, probes=16)
    assert sorted(map(tuple, everything.select("query_id", "rank", "id").collect())) == sorted(map(tuple, exact.select("query_id", "rank", "id").collect()))


def test_clustered_vectors_need_few_lists(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16)) * 10
    df = spark.createDataFrame([(i, "c", (centres[i % 20] + rng.normal(size=16)).tolist()) for i in range(600)], "id long, collection string, vector array<double>")
    assert index.fit(df, 20).probes <= 2


def test_recall_of_the_query(spark):
    exact = plans.QUERIES["r1_topk_cosine"](spark, oracle.SF_DIR).withColumn("collection", F.lit(""))
    found = plans.QUERIES["r1_approximate"](spark, oracle.SF_DIR).withColumn("collection", F.lit(""))
    assert index.recall(found, exact).agg(F.sum("hits") / F.sum("wanted")).first()[0] >= 0.9


def test_index_of_nothing(spark):
    none = spark.createDataFrame([], RECORDS)
    fitted = index.fit(none)
    assert fitted.centroids.size == 0 and index.indexed(none, fitted).count() == 0
    assert index.search(index.indexed(none, fitted), fitted, none.withColumnRenamed("id", "query_id")).count() == 0


def test_mean_by(spark):
    data = [(1, [1.0, 2.0]), (1, [3.0, 6.0]), (1, None), (1, [1.0]), (2, None), (None, [5.0, 5.0])]
    df = spark.createDataFrame(data, "g int, v array<double>")
    assert {r.g: (r["mean"], r.n) for r in V.mean_by(df, ["g"], "v", 2).collect()} == {1: ([2.0, 4.0], 2), 2: (None, 0), None: ([5.0, 5.0], 1)}
