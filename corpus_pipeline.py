"""A training corpus from documents, in five stages; each works on all that the one before it kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import bpe, common, decontaminate, line_dedup, ngram_join, quality, queries


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fit on this corpus' labels, does not reject."""
    return quality.kept(docs, quality.fit(docs, common.read(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without repeated passages; n_chars is that of the text that stays (null for a null text)."""
    out = line_dedup.cleaned(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that hang together by shingle similarity, the one with the least doc_id."""
    return ngram_join.one_of_each(docs)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.clean(docs, common.read(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, decoded again: doc_id, n_tokens and the digests of ids and decoded bytes."""
    return bpe.round_trip(docs, queries.vocabulary("byte_bpe_multi_50k.tiktoken"), queries.split_pattern())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near copies", near_stage),
    ("benchmark", leak_stage),
    ("tokens", token_stage),
]

#: SQL can't express the classifier, the chunk hashes or the tokenizer; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's result written as Parquet below the shared folder and read again."""
    docs, folder = common.read(spark, sf_dir, "documents"), common.shared_dir(spark, f"pipeline-{uuid.uuid4().hex[:8]}")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
