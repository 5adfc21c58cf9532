"""Evaluation: hit rates by type, recall at k, error rates, threshold sweeps."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Answers that go out to all tasks together.
MOST_ANSWERS = 4096


def hit_rates(results: DataFrame) -> DataFrame:
    """Rates of (question_type, session_hit, answer_hit, prompt_tokens), by type and over all (type null), abstentions skipped."""
    kept = results.where(~F.col("question_type").endswith("_abs"))
    return kept.cube("question_type").agg(F.count("*").alias("n"), F.avg(F.col("session_hit").cast("double")).alias("session_rate"), F.avg(F.col("answer_hit").cast("double")).alias("answer_rate"), F.avg("prompt_tokens").alias("mean_tokens"))


def recall_at(ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 8)) -> DataFrame:
    """Per query: recall at each k and the reciprocal rank of the first relevant result."""
    total = relevant.groupBy("query_id").agg(F.count("*").alias("relevant"))
    hits = ranked.join(relevant, ["query_id", "id"], "left_semi").groupBy("query_id").agg(*[F.count_if(F.col("rank") <= k).alias(f"n{k}") for k in ks], F.min("rank").alias("best"))
    out = total.join(hits, "query_id", "left")
    return out.select("query_id", *[(F.coalesce(f"n{k}", F.lit(0)) / F.least("relevant", F.lit(k))).alias(f"recall_{k}") for k in ks], F.coalesce(1.0 / F.col("best"), F.lit(0.0)).alias("mrr"))


def recall_by_collection(ranked: DataFrame, queries: DataFrame, records: DataFrame, ks: tuple[int, ...] = (1, 3, 8)) -> DataFrame:
    """``recall_at`` where a query's relevant records are all others of its own collection: counted, never listed.

    ranked: query_id, rank, id, collection; queries: query_id, collection (of records themselves); records: collection.
    """
    sizes = records.groupBy("collection").agg((F.count("*") - 1).alias("relevant")).where("relevant > 0")
    total = queries.select("query_id", "collection").join(sizes, "collection")
    hit = ranked.join(queries.select("query_id", F.col("collection").alias("_own")), "query_id").where("collection = _own")
    hits = hit.groupBy("query_id").agg(*[F.count_if(F.col("rank") <= k).alias(f"n{k}") for k in ks], F.min("rank").alias("best"))
    out = total.join(hits, "query_id", "left")
    return out.select("query_id", *[(F.coalesce(f"n{k}", F.lit(0)) / F.least("relevant", F.lit(k))).alias(f"recall_{k}") for k in ks], F.coalesce(1.0 / F.col("best"), F.lit(0.0)).alias("mrr"))


def failure_jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how far two runs fail at the same queries (query_id), as the Jaccard similarity of their failures; 1 if neither fails."""
    both = a.select("query_id").distinct().withColumn("_a", F.lit(1)).join(b.select("query_id").distinct().withColumn("_b", F.lit(1)), "query_id", "full_outer")
    return both.agg(F.count("_a").alias("first"), F.count("_b").alias("second"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("common"), F.count("*").alias("n")).select("first", "second", "common", F.coalesce(F.try_divide(F.col("common").cast("double"), F.col("n")), F.lit(1.0)).alias("jaccard"))


def error_rates(rows: DataFrame) -> DataFrame:
    """Shares of false positives among negatives and false negatives among positives of (expected, got)."""
    e, g = F.col("expected"), F.col("got")
    return rows.agg(F.try_divide(F.count_if(~e & g).cast("double"), F.count_if(~e)).alias("fp"), F.try_divide(F.count_if(e & ~g).cast("double"), F.count_if(e)).alias("fn"))


def sweep(values: DataFrame, thresholds: tuple[float, ...] = (0.65, 0.75, 0.85)) -> DataFrame:
    """How many values reach each threshold: one pass, no join."""
    counts = values.agg(F.count("*").alias("n"), *[F.count_if(F.col("value") >= t).alias(f"c{i}") for i, t in enumerate(thresholds)])
    return counts.select(F.col("n"), F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"c{i}").alias("reached")) for i, t in enumerate(thresholds)])).alias("s")).select("s.threshold", "s.reached", "n")


def survival(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per group of (wanted, survived) rows: wanted, survived of them, survived though not wanted (also as a share of wanted), missed."""
    w, s = F.col("wanted"), F.col("survived")
    return rows.groupBy(*by).agg(F.count_if(w).alias("wanted"), F.count_if(w & s).alias("kept"), F.count_if(~w & s).alias("false_kept"), F.count_if(w & ~s).alias("missed"), F.try_divide(F.count_if(~w & s).cast("double"), F.count_if(w)).alias("p_fp"))


def miss_class(answer: Column, prompt: Column) -> Column:
    """Why a question was missed: the answer is in the prompt, some of its terms are, or none."""
    terms = T.keywords(answer)
    return F.when(F.contains(F.lower(prompt), F.lower(answer)), "answer_present").when(F.size(F.array_intersect(terms, T.terms(prompt))) > 0, "related").otherwise("none")


def miss_counts(answers: DataFrame, prompts: DataFrame) -> DataFrame:
    """How many prompts (text) are of each ``miss_class`` for each answer (item_id, answer): rows (item_id, miss, n).

    Answers go out in blocks of about ``MOST_ANSWERS`` (a bounded broadcast), each block scans the prompts once and finds
    answers by their terms; what is shuffled is tasks x answers x classes rows.
    """
    schema = "item_id long, miss string, n long"
    key = F.xxhash64("item_id", "answer")
    wanted = answers.select(F.col("item_id").cast("long").alias("item_id"), F.lower("answer").alias("low"), T.terms(F.col("answer")).alias("terms"), T.keywords(F.col("answer")).alias("keywords"), key.alias("key"))
    parts = max(1, -(-wanted.count() // MOST_ANSWERS))
    texts = prompts.select(F.lower("text").alias("low"), T.terms(F.col("text")).alias("terms"))
    out = answers.sparkSession.createDataFrame([], schema)
    for p in range(parts):
        shared = answers.sparkSession.sparkContext.broadcast([tuple(r)[:4] for r in wanted.where(F.pmod("key", F.lit(parts)) == p).collect()])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            rows = shared.value
            by_keyword, by_inner, always = defaultdict(list), defaultdict(list), []
            # The first and last term of an answer may be part of a longer one in the prompt; those between are terms there too.
            inner = [frozenset((r[2] or [])[1:-1]) for r in rows]
            for k, (_, low, _, keywords) in enumerate(rows):
                for w in keywords or []:
                    by_keyword[w].append(k)
                if low is not None:
                    (by_inner[max(inner[k], key=len)] if inner[k] else always).append(k)
            n, present, related = 0, np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            for b in batches:
                n += b.num_rows
                for low, terms in zip(b.column("low").to_pylist(), b.column("terms").to_pylist(), strict=True):
                    if low is None:
                        continue
                    words, found, shares = set(terms), np.zeros(len(rows), bool), np.zeros(len(rows), bool)
                    for w in words:
                        shares[by_keyword.get(w, [])] = True
                        found[[k for k in by_inner.get(w, ()) if inner[k] <= words and rows[k][1] in low]] = True
                    found[[k for k in always if rows[k][1] in low]] = True
                    present += found
                    related += shares & ~found
            ids = pa.array([r[0] for r in rows], pa.int64())
            for name, count in (("answer_present", present), ("related", related), ("none", n - present - related)):
                yield pa.RecordBatch.from_arrays([ids, pa.array([name] * len(rows), pa.string()), pa.array(count)], ["item_id", "miss", "n"])

        out = out.unionByName(texts.mapInArrow(run, schema))
    return out.groupBy("item_id", "miss").agg(F.sum("n").alias("n")).where("n > 0")
