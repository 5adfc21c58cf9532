"""Authored Markdown documents to tiered nodes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markdown
from ..functions import text as T
from .modality import mask

FRONT = r"(?s)\A---\n(.*?)(?:\n|(?<=\n))(?:---|\.\.\.)(?:\n|\z)"


def frontmatter(text: Column) -> Column:
    """The lines between the opening --- and the closing --- or ...; empty if there are none."""
    return F.regexp_extract(text, FRONT, 1)


def body(text: Column) -> Column:
    return F.regexp_replace(text, FRONT, "")


def hop_targets(front: Column, key: str = "hop_targets") -> Column:
    """Targets of the frontmatter's key: a scalar, [a, b], or a list of "- " lines; distinct, quotes taken off."""
    line = F.trim(F.regexp_extract(front, rf"(?m)^{key}:[ \t]*([^\n]*)$", 1))
    inline = F.split(F.regexp_replace(line, r"^\[|\]$", ""), ",")
    listed = F.regexp_extract_all(F.regexp_extract(front, rf"(?m)^{key}:[ \t]*\n((?:[ \t]*-[^\n]*(?:\n|\z))+)", 1), F.lit(r"(?m)^[ \t]*-[ \t]*([^\n]*)$"), F.lit(1))
    bare = F.transform(F.when(line != "", inline).otherwise(listed), lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", ""))
    return F.array_distinct(F.filter(bare, lambda x: x != ""))


def nodes(docs: DataFrame) -> DataFrame:
    """Nodes of (source_doc, text) documents: ordinal, kind, tier, text, position, token_estimate, promoted, modality_mask, hop_targets.

    A node is the frontmatter, an item of a top-level list with all that lies below it, a quote, a paragraph, a heading, code or HTML. Tier 1 is for list
    items and frontmatter, 2 for quotes and promoted paragraphs, 0 for the rest. ``position`` is the byte at which a node's text begins. Blocks are read document by
    document in Arrow batches; nothing is shuffled.
    """
    d = docs.select("source_doc", F.coalesce("text", F.lit("")).alias("raw"))
    front = frontmatter(F.col("raw"))
    rows = d.withColumn("_front", front).withColumn("_hops", hop_targets(F.col("_front"))).withColumn("_base", F.octet_length(F.regexp_extract("raw", FRONT, 0)))
    body_nodes = F.transform(_blocks(body(F.col("raw"))), lambda b: F.struct(b["kind"].alias("kind"), (b["position"] + F.col("_base")).alias("position"), b["text"].alias("text")))
    head = F.regexp_replace("_front", r"(?U)^\s+|\s+$", "")
    first = F.when(head != "", F.array(F.struct(F.lit("frontmatter").alias("kind"), F.lit(0).cast("long").alias("position"), head.alias("text")))).otherwise(F.array().cast("array<struct<kind:string,position:bigint,text:string>>"))
    found = rows.select("source_doc", "_hops", F.posexplode(F.concat(first, body_nodes)).alias("ordinal", "b")).select("source_doc", "_hops", "ordinal", "b.*")
    found = found.withColumn("modality_mask", mask(F.when(F.col("kind") == "paragraph", F.col("text")))).withColumn("promoted", F.col("modality_mask") != 0)
    tier = F.when(F.col("kind").isin("list", "frontmatter"), 1).when((F.col("kind") == "blockquote") | F.col("promoted"), 2).otherwise(0)
    hops = F.when(F.col("tier") == 0, F.col("_hops")).otherwise(F.array().cast("array<string>"))
    return found.withColumn("tier", tier).select("source_doc", "ordinal", "position", "kind", "tier", "text", T.tokens_ceil(F.col("text")).alias("token_estimate"), "promoted", "modality_mask", hops.alias("hop_targets"))


def _blocks(text: Column) -> Column:
    """The top-level blocks of Markdown texts: an array of (kind, position, text)."""

    @F.pandas_udf("array<struct<kind:string,position:bigint,text:string>>")
    def read(texts: pd.Series) -> pd.Series:
        return pd.Series([[b._asdict() for b in markdown.top_blocks(t or "")] for t in texts])

    return read(text)


def cache_key(text: Column, tokenizer: Column) -> Column:
    return F.sha2(F.concat(text.cast("binary"), F.unhex(F.lit("00")), tokenizer.cast("binary")), 256)
