"""Data model: turns, vectors and records as typed DataFrames, read from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2024-01-01T00:00:00Z; conversations are an hour apart, their turns a minute.
EPOCH_MS = 1704067200000
HOUR_MS, MINUTE_MS = 3_600_000, 60_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str, sessions: int | None = None) -> DataFrame:
    """Session turns. ``sessions``: conversations are dealt to so many longer sessions, else each is its own."""
    c = table(spark, sf_dir, "conversations")
    session = F.col("conv_id") if sessions is None else F.col("conv_id") % sessions
    return c.select(
        session.alias("session_id"),
        F.concat(F.lpad(F.col("conv_id").cast("string"), 8, "0"), F.lit(":"), F.lpad(F.col("turn").cast("string"), 4, "0")).alias("id"),
        "text",
        "role",
        (F.lit(EPOCH_MS) + F.col("conv_id") * HOUR_MS + F.col("turn") * MINUTE_MS).alias("ts_ms"),
        (F.col("conv_id") % 20).alias("user_ns"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector records: id, vector of doubles, collection."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), F.concat(F.lit("label:"), F.col("label")).alias("collection"))


def scope(collection: Column) -> Column:
    """The kind of a collection: what stands before the first colon."""
    return F.substring_index(collection, ":", 1)


def namespace(user_id: Column, session_key: Column, agent_id: Column, fallback: Column) -> Column:
    """The durable namespace: the first of these that isn't blank, else "default"."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(filled(user_id), F.concat(F.lit("session-key:"), filled(session_key)), F.concat(F.lit("agent-id:"), filled(agent_id)), filled(fallback), F.lit("default"))
