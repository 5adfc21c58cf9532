"""The operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, clustering, common, decontaminate, fim, html_wrapper, line_dedup, minhash, ngram_join, quality, secrets, sharding, sql, token_store, warc


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; such files are never part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.with_following(common.read(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.stored(spark, common.read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(common.read(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), split_pattern())


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.extracted(common.read(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fit(docs, common.read(spark, sf_dir, "labels")))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(common.read(spark, sf_dir, "documents"))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(common.read(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.cleaned(common.read(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), F.col("_removed_lines").alias("removed_lines"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(spark, common.read(spark, sf_dir, "pages"))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clusters(common.read(spark, sf_dir, "embeddings"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.found(common.read(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(common.read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_fingerprint, op2_decontaminate, op3_token_files, op4_byte_bpe, op5_html_text, op6_quality, op7_ngram_join, op8_shards, op9_line_dedup, op10_warc, op11_clusters, op12_secrets, op13_fill_in_middle)}

ORACLE_SQL = {
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        m AS (SELECT html, max(page_id) AS best FROM p GROUP BY html),
        d AS (SELECT p.page_id, octet_length(encode(p.html)) AS payload_bytes, sha1(p.html) || '0' AS h, m.best FROM p JOIN m ON p.html = m.html)
        SELECT page_id, payload_bytes,
          array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            (((('0x' || substr(h, (5 * i) // 4 + 1, 2))::INT >> (3 - (5 * i) % 4)) & 31) + 1)::INT, 1)), '') AS payload_digest,
          CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
          CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
        FROM d
    """,
    "op11_clusters": sql.clusters(),
    "op12_secrets": sql.secrets(),
    "op13_fill_in_middle": sql.fill_in_middle(),
}
