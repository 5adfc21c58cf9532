"""Streams of turns: duplicates dropped within an hour, tokens gathered by session until compaction is due."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def deduplicated(turns: DataFrame, within: str = "1 hour") -> DataFrame:
    """Each turn once by (session, index, role, text digest), as long as copies come within the given time.

    turns: session_id, turn, role, text, ts (timestamp).
    """
    keyed = turns.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    return keyed.withWatermark("ts", within).dropDuplicatesWithinWatermark(["session_id", "turn", "role", "digest"])


def triggers(turns: DataFrame, threshold: int = 2000) -> DataFrame:
    """(session_id, fired, tokens): how often a session's running token sum reached ``threshold`` (and began anew) and what it holds now; 0 or less never fires."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tokens, fired = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        for n in rows.tokens:
            tokens += int(n)
            if 0 < threshold <= tokens:
                tokens, fired = 0, fired + 1
        state.update((tokens, fired))
        yield pd.DataFrame({"session_id": [key[0]], "fired": [fired], "tokens": [tokens]})

    from pyspark.sql.streaming.state import GroupStateTimeout

    counted = turns.select("session_id", "id", "ts", T.tokens_packed(F.coalesce("text", F.lit(""))).alias("tokens"))
    return counted.groupBy("session_id").applyInPandasWithState(step, "session_id long, fired long, tokens long", "tokens long, fired long", "update", GroupStateTimeout.NoTimeout)


def completed(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there, into Parquet files below ``folder``, and reads these."""
    spark: SparkSession = stream.sparkSession
    out = f"{folder}/out-{uuid.uuid4().hex}"

    def put(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")  # the same epoch again replaces itself

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state-{uuid.uuid4().hex}").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    return spark.read.parquet(out)
