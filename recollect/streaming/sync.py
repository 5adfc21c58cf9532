"""Keeping what is read from files in step with a tree of them: authored nodes, diary entries.

Spark's file source knows files by their path: it gives neither changed files again nor tells of those that vanish. So the stream here is one of
ticks, and each tick compares a listing with what is known. A change is taken once it has rested for ``quiet_ms``; what is younger waits for a
later tick. Every tick appends to two logs below a folder, ``files`` (what changed, and how) and ``parts`` (what the changed files hold), in a
partition of its own, which it replaces if it runs again. ``current`` is the view of the logs: of each path the parts of its last change.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import authored

QUIET_MS = 150
LOG = "path string, change string, size long, mtime_ms long, digest string, epoch int"


def changes(files: DataFrame, known: DataFrame) -> DataFrame:
    """(path, change) of what differs: "new", "changed" (size or time differ, and then the text's digest) or "gone".

    files: path, text, size, mtime_ms; known: path, size, mtime_ms, digest. Digests are only taken where size or time differ.
    """
    now, old = files.alias("n"), known.alias("o")
    both = now.join(old, F.col("n.path") == F.col("o.path"), "full_outer")
    touched = (F.col("n.size") != F.col("o.size")) | (F.col("n.mtime_ms") != F.col("o.mtime_ms"))
    differs = F.when(touched, F.sha2(F.col("n.text"), 256) != F.col("o.digest")).otherwise(False)
    change = F.when(F.col("o.path").isNull(), "new").when(F.col("n.path").isNull(), "gone").when(differs, "changed")
    return both.select(F.coalesce("n.path", "o.path").alias("path"), change.alias("change")).where("change is not null")


def synced(nodes: DataFrame, files: DataFrame, changed: DataFrame) -> DataFrame:
    """Nodes with those of changed and vanished files replaced."""
    kept = nodes.join(changed.select(F.col("path").alias("source_doc")), "source_doc", "left_anti")
    fresh = files.join(changed.where("change <> 'gone'").select("path"), "path", "left_semi").select(F.col("path").alias("source_doc"), "text")
    return kept.unionByName(authored.nodes(fresh))


def state(files: DataFrame) -> DataFrame:
    return files.select("path", "size", "mtime_ms", F.sha2("text", 256).alias("digest"))


def log(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The log of files, up to the tick ``before``."""
    rows = spark.read.schema(LOG).parquet(f"{folder}/files")
    return rows.where("epoch >= 0") if before is None else rows.where((F.col("epoch") >= 0) & (F.col("epoch") < before))


def latest(rows: DataFrame) -> DataFrame:
    """Of each path of a log the last change; vanished paths are left out."""
    w = Window.partitionBy("path").orderBy(F.desc("epoch"))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1 and change <> 'gone'").drop("_r")


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The parts of all files as they are now."""
    now = latest(log(spark, folder)).select(F.col("path").alias("source_doc"), "epoch")
    return spark.read.parquet(f"{folder}/parts").join(now, ["source_doc", "epoch"], "left_semi").drop("epoch")


def tick(files: DataFrame, folder: str, epoch: int, now_ms: int, parse: Callable[[DataFrame], DataFrame] = authored.nodes, quiet_ms: int = QUIET_MS) -> None:
    """Brings the logs in step with a listing (path, text, size, mtime_ms) of all files there are. ``parse`` makes parts of (source_doc, text) rows."""
    spark = files.sparkSession
    known = latest(log(spark, folder, epoch)).select("path", "size", "mtime_ms", "digest")
    rests = files.where(F.col("mtime_ms") <= now_ms - quiet_ms)
    # Whether a file is gone is seen from the whole listing, whether it changed only once it rests.
    gone = known.join(files.select("path"), "path", "left_anti").select("path", F.lit("gone").alias("change"))
    other = changes(rests, known).where("change <> 'gone'")
    rows = other.unionByName(gone).join(state(rests), "path", "left")
    rows.select("path", "change", F.col("size").cast("long"), F.col("mtime_ms").cast("long"), "digest").write.mode("overwrite").parquet(f"{folder}/files/epoch={epoch}")
    done = spark.read.parquet(f"{folder}/files/epoch={epoch}").where("change <> 'gone'")
    fresh = files.join(done.select("path"), "path", "left_semi").select(F.col("path").alias("source_doc"), "text")
    parse(fresh).write.mode("overwrite").parquet(f"{folder}/parts/epoch={epoch}")


def _prepared(spark: SparkSession, folder: str, parse: Callable[[DataFrame], DataFrame]) -> None:
    """Logs without a row, so that the first tick has something to read."""
    spark.createDataFrame([], LOG).drop("epoch").write.mode("ignore").parquet(f"{folder}/files/epoch=-1")
    parse(spark.createDataFrame([], "source_doc string, text string")).write.mode("ignore").parquet(f"{folder}/parts/epoch=-1")


def follow(spark: SparkSession, listing: Callable[[], DataFrame], folder: str, parse: Callable[[DataFrame], DataFrame] = authored.nodes, every: str | None = None, quiet_ms: int = QUIET_MS, clock: Callable[[], int] = lambda: int(time.time() * 1000)):
    """Starts a stream of ticks, each of which lists the files anew; gives the running query.

    ``every`` is the time between ticks; without it one tick is made and the query ends. The logs and the stream's own state are below ``folder``, so a
    query that is started again goes on where the last one stopped.
    """
    _prepared(spark, folder, parse)
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    start = ticks.writeStream.option("checkpointLocation", f"{folder}/ticks").foreachBatch(lambda _, epoch: tick(listing(), folder, epoch, clock(), parse, quiet_ms))
    return (start.trigger(processingTime=every) if every else start.trigger(availableNow=True)).start()
