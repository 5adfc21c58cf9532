"""Session windows: recent tail, chronological buckets, prior context."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import vector as V


def ordered():
    return Window.partitionBy("session_id").orderBy("ts_ms", "id")


def latest_first():
    return Window.partitionBy("session_id").orderBy(F.desc("ts_ms"), F.desc("id"))


def tail_marks(turns: DataFrame, min_turns: int = 4, cost: str = "tokens") -> DataFrame:
    """Turns with _back (1 for a session's last), _used (cost from there to the end), _base (cost of the last ``min_turns``) and bundle.

    Neighbours of the roles user and assistant, either way round, are one bundle; bundles are numbered as islands.
    """
    total = F.sum(cost).over(latest_first().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    base = F.sum(F.when(F.col("_back") <= min_turns, F.col(cost))).over(Window.partitionBy("session_id"))
    before = F.lag("role").over(ordered())
    coupled = ((before == "user") & (F.col("role") == "assistant")) | ((before == "assistant") & (F.col("role") == "user"))
    t = turns.withColumn("_back", F.row_number().over(latest_first())).withColumn("_used", total).withColumn("_base", base)
    return t.withColumn("bundle", F.sum(F.when(F.coalesce(coupled, F.lit(False)), 0).otherwise(1)).over(ordered()))


def tail_split(turns: DataFrame, min_turns: int = 4, budget: int = 128, cost: str = "tokens") -> DataFrame:
    """Turns with ``recent``: the last ``min_turns``, more while they fit the budget, and the bundle the border falls into, which a border never cuts."""
    t = tail_marks(turns, min_turns, cost)
    near = (F.col("_back") <= min_turns) | ((F.col("_base") <= budget) & (F.col("_used") <= budget))
    first_bundle = F.min(F.when(near, F.col("bundle"))).over(Window.partitionBy("session_id"))
    return t.withColumn("in_base", F.col("_back") <= min_turns).withColumn("recent", F.col("bundle") >= first_bundle).drop("_back", "_used", "_base")


def tails(queries: DataFrame, turns: DataFrame, min_turns: int = 4) -> DataFrame:
    """(query_id, id, ts_ms, in_base, tokens): the tail of each query's session; ``tail_split`` for many queries (query_id, session_id, room, base_only) of a session.

    Turns are marked once a session, not once a query. Costs are never negative, so a bundle is in the tail if its last turn is near: with the
    turn it carries the number and cost that its last turn has. Turns that fit no query of their session are left out before queries meet them,
    so that no more pairs are made than the tails of a session's queries, each as long as the longest.
    """
    of_bundle = Window.partitionBy("session_id", "bundle")
    marked = tail_marks(turns, min_turns).withColumn("_first", F.min("_back").over(of_bundle)).withColumn("_least", F.min("_used").over(of_bundle))
    near = lambda room: (F.col("_first") <= min_turns) | ((F.col("_base") <= room) & (F.col("_least") <= room))
    widest = queries.groupBy("session_id").agg(F.max("room").alias("_widest"))
    few = marked.join(widest, "session_id").where(near(F.col("_widest"))).drop("_widest")
    found = queries.join(few, "session_id").where(F.when(F.col("base_only"), F.col("_back") <= min_turns).otherwise(near(F.col("room"))))
    return found.select("query_id", "id", "ts_ms", (F.col("_back") <= min_turns).alias("in_base"), "tokens")


def buckets(turns: DataFrame, target: int = 20) -> DataFrame:
    """Turns with ``bucket``: ceil(n / target) contiguous parts, turn i of n in part floor(i * parts / n)."""
    n = F.count("*").over(Window.partitionBy("session_id"))
    at = F.row_number().over(ordered()) - 1
    parts = F.ceil(F.col("_n") / target).cast("long")
    return turns.withColumn("_n", n).withColumn("_at", at).withColumn("bucket", F.floor(F.col("_at") * parts / F.col("_n")).cast("long")).drop("_n", "_at")


def cluster_aggregates(dealt: DataFrame) -> DataFrame:
    """Per (session_id, bucket): turns, first and last time, mean gating score (none counts 0) from 0 to 1, and the first user in time that is known."""
    known = F.when(F.col("user_id").isNotNull(), F.struct("ts_ms", "id"))
    mean = F.avg(F.coalesce(F.col("gating_score"), F.lit(0.0)))
    return dealt.groupBy("session_id", "bucket").agg(F.count("*").alias("turns"), F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.greatest(F.least(mean, F.lit(1.0)), F.lit(0.0)).alias("mean_gating"), F.min_by("user_id", known).alias("user_id"))


class _Newest:
    """Of the summaries met so far those that can still be taken: newest last.

    A summary is taken if it fits what the newer ones leave. Once newer ones of its size or less fill the budget together with it, it never
    fits again: either they are all taken, or one of them did not fit already. So few are kept, whatever came before.
    """

    def __init__(self, budget: int):
        self.budget, self.kept, self.any = budget, [], False

    def add(self, tokens: int, text: str) -> None:
        self.any = True
        self.kept.append((tokens, text))
        if len(self.kept) > 64:
            newer, kept = [], []
            for c, t in reversed(self.kept):
                if sum(x for x in newer if x <= c) + c <= self.budget:
                    kept.append((c, t))
                newer.append(c)
            self.kept = kept[::-1]

    def taken(self) -> tuple[int, list[str]]:
        used, texts = 0, []
        for c, t in reversed(self.kept):
            if used + c <= self.budget:
                used += c
                texts.append(t)
        return used, texts[::-1]


def prior_context(starts: DataFrame, summaries: DataFrame, budget: int = 96) -> DataFrame:
    """For each (session_id, bucket, start_ms) the summaries before it, newest first while they fit (others skipped), joined oldest first.

    summaries: session_id, ts_ms, id, text, tokens. One ordered pass over a session's starts and summaries; of the summaries only those are held that a
    later start could still take. Starts before any summary have no row.
    """
    none = lambda kind: F.lit(None).cast(kind)
    asked = starts.select("session_id", F.col("start_ms").alias("ts_ms"), F.lit(0).alias("kind"), F.col("bucket").cast("long").alias("bucket"), none("string").alias("id"), none("long").alias("tokens"), none("string").alias("text"))
    given = summaries.select("session_id", "ts_ms", F.lit(1).alias("kind"), none("long").alias("bucket"), F.col("id").cast("string").alias("id"), F.col("tokens").cast("long").alias("tokens"), "text")
    # Of one time starts come first, and of summaries the least id last: it counts as the newest.
    both = asked.unionByName(given).repartition("session_id").sortWithinPartitions("session_id", "ts_ms", "kind", F.desc("id"))
    schema = StructType([starts.schema["session_id"], StructField("bucket", LongType()), StructField("prior_tokens", LongType()), StructField("prior", StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, newest = None, _Newest(budget)
        for df in frames:
            out = []
            for s, kind, bucket, tokens, text in zip(df["session_id"], df["kind"], df["bucket"], df["tokens"], df["text"], strict=True):
                if s != session:
                    session, newest = s, _Newest(budget)
                if kind == 1:
                    newest.add(int(tokens), text)
                elif newest.any:
                    used, texts = newest.taken()
                    out.append((s, int(bucket), used, "\n\n".join(texts)))
            yield pd.DataFrame(out, columns=schema.names)

    return both.mapInPandas(run, schema)


def token_windows(docs: DataFrame, key: str, text: str = "text", size: int = 512, step: int = 256) -> DataFrame:
    """(key, start, words) of each document's windows of ``size`` words, one every ``step``, up to the one that reaches the end (which may be shorter)."""
    words = docs.select(key, F.split(F.coalesce(F.col(text), F.lit("")), " ").alias("_w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("_w") - (size - step) - 1, F.lit(0)), F.lit(step))
    return words.select(key, "_w", F.explode(starts).alias("start")).select(key, "start", F.slice("_w", F.col("start") + 1, size).alias("words"))


def pooled(docs: DataFrame, key: str, embed, dims: int, text: str = "text", size: int = 512, step: int = 256) -> DataFrame:
    """(key, vector, n): the mean of the vectors of each document's windows, at whatever length it comes out."""
    windows = token_windows(docs, key, text, size, step).withColumn("_v", embed(F.array_join("words", " ")))
    return V.mean_by(windows, [key], "_v", dims, "vector")


def recall_projection(turns: DataFrame, min_turns: int = 4, budget: int = 128) -> DataFrame:
    """The searchable view of a session: what the tail doesn't hold, under ids of its own."""
    older = tail_split(turns, min_turns, budget).where(~F.col("recent"))
    return older.select(F.concat(F.lit("session_recall:"), F.col("session_id").cast("string")).alias("collection"), F.concat(F.lit("recall:"), "id").alias("id"), "text", "ts_ms")
