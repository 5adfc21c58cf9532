"""The tries of a summary: by turns, by a model, and what stands in for it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from recollect.functions import vector as V
from recollect.operators import compact

WORDS = ["harbour", "museum", "north", "gate", "ship", "crane"]


def dealt(spark, gating=1.0, texts=None):
    texts = texts or [f"{WORDS[i % 6]} {WORDS[(i + 1) % 6]} note number {i} " + "about the harbour and the museum " * 3 for i in range(6)]
    rows = [("s", 0, f"t{i}", t, i, 1000 if len(t) > 8 else 1, gating, None if i == 0 else f"u{i}") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "session_id string, bucket long, id string, text string, ts_ms long, tokens long, gating_score double, user_ns string")
    return df.withColumn("vector", V.hashed_embedding(F.col("text")))


def only(df):
    return df.collect()[0]


def test_a_good_model_is_taken(spark):
    r = only(compact.escalated(dealt(spark), lambda texts, most: (" ".join(" ".join(texts).split()[:most]), 0.9)))
    assert (r.route, r.method, r.step, r.accepted) == ("abstractive", "abstractive", 0, True) and r.token_count == 64
    assert r.confidence == pytest.approx(0.8 * (r.align + r.cover) / 2 + 0.2 * 0.9) and r.user_ns == "u1"


def test_an_unaligned_model_gives_way(spark):
    r = only(compact.escalated(dealt(spark), lambda texts, most: ("zebra quantum xylophone", 1.0)))
    plain = only(compact.summaries(dealt(spark)))
    assert (r.route, r.method, r.step, r.text) == ("abstractive", "extractive", 0, plain.text) and r.confidence == pytest.approx(plain.confidence)


def test_the_route_is_the_gates(spark):
    model = lambda texts, most: (" ".join(texts)[:40], 1.0)
    assert only(compact.escalated(dealt(spark, 0.59), model)).route == "extractive"
    assert only(compact.escalated(dealt(spark, 0.6), model)).route == "abstractive"
    assert only(compact.escalated(dealt(spark, None), model)).route == "extractive"
    assert only(compact.escalated(dealt(spark, 1.0))).method == "extractive"


def test_tries_until_one_is_shorter(spark):
    texts = ["harbour museum gate ship", "harbour museum gate ship", "harbour museum gate ship", "harbour museum gate ship"]
    rows = dealt(spark, 1.0, texts).withColumn("tokens", F.lit(2).cast("long"))  # eight tokens in all
    words = lambda n: " ".join((texts[0] + " ").split() * 20).split()[:n]
    asked = []

    def long_then_short(texts, most):
        asked.append(most)
        return " ".join(words(64 if most == 64 else 4)), 0.5

    r = only(compact.escalated(rows, long_then_short))
    assert (r.step, r.method, r.token_count, r.accepted) == (1, "abstractive", 4, True)
    r = only(compact.escalated(rows, lambda texts, most: (" ".join(words(most)), 0.5)))  # both too long: the turns at the second density
    assert (r.step, r.method, r.token_count, r.accepted) == (2, "extractive", 4, True)
    r = only(compact.escalated(rows.withColumn("tokens", F.lit(1).cast("long")), lambda texts, most: (" ".join(words(most)), 0.5)))
    assert (r.step, r.method, r.accepted) == (0, "abstractive", False)
