"""Compaction: older turns of a session to extractive summaries with lineage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from ..functions import text as T
from ..functions import vector as V
from . import session

BUCKET = ["session_id", "bucket"]


def older_buckets(turns: DataFrame, target: int = 20, min_turns: int = 4, budget: int = 128) -> DataFrame:
    """Eligible turns before the recent tail, in buckets; sessions of fewer than two such turns and buckets of one are left out."""
    eligible = turns.where(~F.coalesce(F.col("type"), F.lit("turn")).isin("summary", "guidance_shard")) if "type" in turns.columns else turns
    split = session.tail_split(eligible.withColumn("tokens", T.tokens_floor(F.col("text"))), min_turns, budget).where(~F.col("recent"))
    older = split.withColumn("_n", F.count("*").over(Window.partitionBy("session_id"))).where("_n >= 2").drop("_n")
    dealt = session.buckets(older, target)
    return dealt.withColumn("_n", F.count("*").over(Window.partitionBy(*BUCKET))).where("_n >= 2").drop("_n")


def _scored(dealt: DataFrame) -> DataFrame:
    """(bucket, centroid, _turns): each bucket's turns with ``sim``, the cosine to their mean vector, and ``_rank`` by it.

    A bucket's turns are few (its target size), so they are gathered once: the mean, the cosines and the ranks need one shuffle.
    """
    kept = [c for c in dealt.columns if c not in BUCKET]
    before = lambda a, b: F.when((a["ts_ms"] < b["ts_ms"]) | ((a["ts_ms"] == b["ts_ms"]) & (a["id"] < b["id"])), -1).otherwise(1)  # noqa: E731  a row may hold maps, which have no order
    rows = dealt.groupBy(*BUCKET).agg(F.array_sort(F.collect_list(F.struct(*kept)), before).alias("_turns"))
    rows = rows.withColumn("centroid", V.mean(F.transform("_turns", lambda t: t["vector"])))
    rows = rows.withColumn("_turns", F.transform("_turns", lambda t: F.struct(t.alias("t"), V.cosine(t["vector"], F.col("centroid")).alias("sim"))))
    order = F.transform("_turns", lambda x: F.struct((-F.round(x["sim"], 9)).alias("s"), x["t"]["ts_ms"].alias("ts"), x["t"]["id"].alias("id")))
    rows = rows.withColumn("_order", F.transform(F.array_sort(order), lambda o: F.struct(o["ts"].alias("ts"), o["id"].alias("id"))))
    place = lambda x: F.array_position("_order", F.struct(x["t"]["ts_ms"].alias("ts"), x["t"]["id"].alias("id")))
    return rows.withColumn("_turns", F.transform("_turns", lambda x: F.struct(x["t"].alias("t"), x["sim"].alias("sim"), place(x).alias("_rank")))).drop("_order")


def _taken(density: float) -> Column:
    """How many of a bucket's turns a summary of this density has."""
    return F.ceil(F.size("_turns") * F.lit(density))


def extractive(dealt: DataFrame, density: float = 0.4) -> DataFrame:
    """Rows of dealt turns (with ``vector``) with cosine to their bucket's mean vector, and whether chosen: the best ceil(n * density)."""
    rows = _scored(dealt).select(*BUCKET, "centroid", _taken(density).alias("_n"), F.explode("_turns").alias("x"))
    return rows.select(*BUCKET, "centroid", "x.t.*", "x.sim", (F.col("x._rank") <= F.col("_n")).alias("chosen"))


def _bucket_rows(dealt: DataFrame, densities: tuple[float, ...]) -> DataFrame:
    """One row a bucket: id by its sources, ``_text0``, ``_text1``, ...: the chosen turns of each density in order, span, sources, tokens, vectors."""
    rows = _scored(dealt)
    ids = F.transform("_turns", lambda x: x["t"]["id"])
    named = F.concat(F.lit("summary:"), F.substring(F.sha2(F.concat(F.col("session_id").cast("string"), F.lit(":"), F.array_join(F.transform(ids, lambda s: F.concat(s, F.lit(","))), "")), 256), 1, 16))

    def text(density: float) -> Column:
        n = _taken(density)
        return F.array_join(F.transform(F.filter("_turns", lambda x: x["_rank"] <= n), lambda x: x["t"]["text"]), " ")

    gating = lambda x: F.coalesce(x["t"]["gating_score"].cast("double"), F.lit(0.0)) if "gating_score" in dealt.columns else F.lit(0.0)
    user = lambda x: x["t"]["user_ns"].cast("string") if "user_ns" in dealt.columns else F.lit(None).cast("string")
    total = lambda f: F.aggregate(F.transform("_turns", f), F.lit(0.0), lambda s, v: s + v)
    return rows.select(
        *BUCKET, "centroid", named.alias("id"), ids.alias("source_ids"), *[text(d).alias(f"_text{i}") for i, d in enumerate(densities)], F.transform("_turns", lambda x: x["t"]["vector"]).alias("_vectors"),
        F.array_min(F.transform("_turns", lambda x: x["t"]["ts_ms"])).alias("start_ms"), F.array_max(F.transform("_turns", lambda x: x["t"]["ts_ms"])).alias("end_ms"),
        total(lambda x: x["t"]["tokens"].cast("double")).cast("long").alias("source_tokens"), F.size("_turns").cast("long").alias("turns"), F.transform("_turns", lambda x: x["t"]["text"]).alias("_texts"),
        T.clamp(total(gating) / F.size("_turns")).alias("mean_gating"), F.get(F.array_compact(F.transform("_turns", user)), F.lit(0)).alias("user_ns"),
    )


def _grade(text: Column, embed: Callable[[Column], Column]) -> Column:
    """(align, cover) of a summary's text: the cosine of its own vector with the turns' mean, and the mean of its cosines with the turns (none below 0)."""
    near = lambda v: F.aggregate(F.transform("_vectors", lambda x: F.greatest(V.cosine(v, x), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x) / F.size("_vectors")
    return V.bound(embed(text), lambda v: F.struct(V.cosine(v, F.col("centroid")).alias("align"), near(v).alias("cover")))


def _kept(grade: Column) -> Column:
    return T.clamp((grade["align"] + grade["cover"]) / 2)


def _finished(rows: DataFrame) -> DataFrame:
    """Rows with ``text``, ``_grade``, ``confidence`` and ``method`` as summaries."""
    out = rows.withColumn("token_count", T.tokens_words(F.col("text"))).withColumn("align", F.col("_grade.align")).withColumn("cover", F.col("_grade.cover"))
    out = out.withColumn("decay_rate", 1 - F.col("confidence")).withColumn("accepted", F.col("token_count") < F.col("source_tokens"))
    return out.drop("centroid", "_vectors", "_texts", *[c for c in out.columns if c.startswith(("_text", "_grade", "_model"))])


def summaries(dealt: DataFrame, density: float = 0.4, embed: Callable[[Column], Column] = V.hashed_embedding) -> DataFrame:
    """One summary for each bucket: id by its sources, text of the chosen turns in order, how well it keeps them, span, sources.

    ``confidence`` is the mean of align and cover. ``embed`` must be what the turns' vectors came from. ``accepted``: shorter than what it stands for.
    """
    rows = _bucket_rows(dealt, (density,)).withColumn("text", F.col("_text0")).withColumn("_grade", _grade(F.col("text"), embed))
    return _finished(rows.withColumn("confidence", _kept(F.col("_grade"))).withColumn("method", F.lit("extractive")))


#: A model that writes summaries: (texts of the turns in order, most tokens) to (text, score of its decoder from 0 to 1).
Summariser = Callable[[list[str], int], tuple[str, float]]
#: Mean gating score from which a bucket goes to the model; alignment below which its summary gives way to an extractive one; weight of align and cover against the decoder's score.
ROUTE, ALIGNED, WEIGHT = 0.6, 0.65, 0.8
#: Tokens that a model may write at the first and at the second try.
MOST_TOKENS = (64, 32)


def escalated(dealt: DataFrame, model: Summariser | None = None, densities: tuple[float, float] = (0.4, 0.25), embed: Callable[[Column], Column] = V.hashed_embedding) -> DataFrame:
    """Summaries as ``summaries`` gives them, the first of each bucket's tries that is shorter than its sources; declined (at the first try) if none is.

    A bucket is summarised by its turns, denser at the second try. One whose turns' mean gating score reaches ``ROUTE`` goes to the model, if there is
    one, with fewer tokens at the second try, and then to its turns at the second density; a model's summary that is not aligned with the turns gives
    way to the extractive one of the first density. ``step`` says which try it is, ``route`` where the bucket went, ``method`` what the summary came from.
    """
    rows = _bucket_rows(dealt, densities)
    shorter = lambda text: T.tokens_words(text) < F.col("source_tokens")
    plain = F.when(~shorter(F.col("_text0")) & shorter(F.col("_text1")), 1).otherwise(0)
    if model is None:
        out = rows.withColumn("step", plain).withColumn("text", F.when(F.col("step") == 1, F.col("_text1")).otherwise(F.col("_text0"))).withColumn("_grade", _grade(F.col("text"), embed))
        return _finished(out.withColumn("confidence", _kept(F.col("_grade"))).withColumn("method", F.lit("extractive")).withColumn("route", F.lit("extractive")))
    rows = _written(rows.withColumn("route", F.when(F.round("mean_gating", 9) >= ROUTE, "abstractive").otherwise("extractive")).withColumn("_ok0", shorter(F.col("_text0"))), model).drop("_ok0")

    asked, model_text, score = F.col("route") == "abstractive", lambda k: F.get("_model", F.lit(k))["text"], F.get("_model", F.col("step"))["score"]
    yes = lambda c: F.coalesce(c, F.lit(False))
    # Each try is a column of its own; a model's later text is graded only where the earlier did not do.
    rows = rows.withColumn("_grade0", F.when(asked, _grade(model_text(0), embed))).withColumn("_fits0", yes(F.col("_grade0.align") >= ALIGNED))
    rows = rows.withColumn("_text_0", F.when(F.col("_fits0"), model_text(0)).otherwise(F.col("_text0"))).withColumn("_ok0", shorter(F.col("_text_0")))
    rows = rows.withColumn("_grade1", F.when(asked & ~F.col("_ok0"), _grade(model_text(1), embed))).withColumn("_fits1", yes(F.col("_grade1.align") >= ALIGNED))
    rows = rows.withColumn("_text_1", F.when(F.col("_fits1"), model_text(1)).when(asked, F.col("_text0")).otherwise(F.col("_text1")))
    step = F.when(F.col("_ok0"), 0).when(shorter(F.col("_text_1")), 1).when(asked & shorter(F.col("_text1")), 2).otherwise(0)
    out = rows.withColumn("step", step).withColumn("text", F.when(F.col("step") == 0, F.col("_text_0")).when(F.col("step") == 1, F.col("_text_1")).otherwise(F.col("_text1")))
    by_model = F.when(F.col("step") == 0, F.col("_fits0")).when(F.col("step") == 1, F.col("_fits1")).otherwise(False)
    out = out.withColumn("method", F.when(by_model, "abstractive").otherwise("extractive"))
    out = out.withColumn("_grade", F.when(F.col("method") == "extractive", _grade(F.col("text"), embed)).when(F.col("step") == 0, F.col("_grade0")).otherwise(F.col("_grade1")))
    own = _kept(F.col("_grade"))
    out = out.withColumn("confidence", F.when(F.col("method") == "extractive", own).otherwise(T.clamp(WEIGHT * own + (1 - WEIGHT) * T.clamp(score))))
    return _finished(out.drop("_fits0", "_fits1", "_ok0"))


def _written(rows: DataFrame, model: Summariser) -> DataFrame:
    """Rows with ``_model``: what the model writes of the buckets that go to it; the second, shorter text only where the first or what stands in for it may not do."""
    schema = StructType([*rows.schema.fields, StructField("_model", ArrayType(StructType([StructField("text", StringType()), StructField("score", DoubleType())])))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            made = []
            for texts, route, ok, tokens in zip(df["_texts"], df["route"], df["_ok0"], df["source_tokens"], strict=True):
                out = []
                for most in MOST_TOKENS if route == "abstractive" else ():
                    text, score = model(list(texts), most)
                    out.append({"text": text, "score": float(score)})
                    if ok and len(text.split()) < tokens:
                        break
                made.append(out)
            yield df.assign(_model=made)

    return rows.mapInPandas(run, schema)


def routes(dealt: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Per bucket the mean gating score of its turns (0 where a turn has none), and which summariser it goes to."""
    mean = F.avg(F.coalesce(F.col("gating_score"), F.lit(0.0)))
    out = dealt.groupBy(*BUCKET).agg(mean.alias("mean_gating"), F.count("*").alias("turns"))
    return out.withColumn("route", F.when(F.round("mean_gating", 9) >= threshold, "abstractive").otherwise("extractive"))


def edges(summary_rows: DataFrame) -> DataFrame:
    """Coverage edges summary -> turn, in order."""
    return summary_rows.select("session_id", F.col("id").alias("parent_summary_id"), F.posexplode("source_ids").alias("edge_order", "child_id"), F.lit("turn").alias("child_type"))


def result(summary_rows: DataFrame) -> DataFrame:
    """Per session: clusters formed and declined, turns covered, mean confidence, and the method (mixed, if several were used; null, if nothing was formed)."""
    ok = F.col("accepted")
    used = F.when(ok, F.col("method"))
    method = F.when(F.min(used) == F.max(used), F.min(used)).when(F.min(used).isNotNull(), F.lit("mixed"))
    return summary_rows.groupBy("session_id").agg(
        F.count_if(ok).alias("formed"), F.count_if(~ok).alias("declined"), F.sum(F.when(ok, F.col("turns")).otherwise(0)).alias("turns_covered"), F.avg(F.when(ok, F.col("confidence"))).alias("mean_confidence"), method.alias("method")
    )


def expanded(edge_rows: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """What root summaries stand for, along the edges: (root, child_id, depth); a bounded number of joins, cycles end by depth.

    A child of type "summary" is followed and not given out, but at the last depth, where it is given out itself; any other child is given out.
    """
    step = roots.select(F.col("id").alias("root"), F.col("id").alias("node"))
    links = edge_rows.select(F.col("parent_summary_id").alias("node"), "child_id", F.coalesce(F.col("child_type") == "summary", F.lit(False)).alias("inner"))
    out = None
    for d in range(1, depth + 1):
        children = step.join(links, "node").select("root", "child_id", "inner")
        part = (children if d == depth else children.where(~F.col("inner"))).select("root", "child_id", F.lit(d).alias("depth"))
        step = children.where("inner").select("root", F.col("child_id").alias("node"))
        out = part if out is None else out.unionByName(part)
    return out
