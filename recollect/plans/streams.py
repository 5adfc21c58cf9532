"""Streaming behaviour, run to completion over conversations, and authored documents."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..operators import authored, modality
from ..operators import store
from ..sources import files
from ..streaming import sync
from ..streaming import turns as streaming
from . import modality as rules
from .common import registry

QUERIES, ORACLE_SQL, query = registry()


def _folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of this machine only where none is named (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{root.rstrip('/')}/streams" if root else "file://" + tempfile.mkdtemp(prefix="spark-streams-")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/conversations.parquet"
    # A pattern stands for a file as well as for a folder of files; a plain path must be a folder.
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/conversations.parque[t]")
    ms = F.lit(model.EPOCH_MS) + F.col("conv_id") * model.HOUR_MS + F.col("turn") * model.MINUTE_MS
    return rows.select((F.col("conv_id") % 10).alias("session_id"), F.concat_ws(":", F.lpad(F.col("conv_id").cast("string"), 8, "0"), F.lpad(F.col("turn").cast("string"), 4, "0")).alias("id"), F.col("turn").alias("turn"), "conv_id", "role", "text", F.timestamp_millis(ms).alias("ts"))


@query("""SELECT conv_id, turn, role, count(*) AS n FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations) GROUP BY 1, 2, 3""")
def z1_stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("session_id", F.col("conv_id"))
    once = streaming.completed(streaming.deduplicated(rows), _folder(spark))
    return once.groupBy("conv_id", "turn", "role").agg(F.count("*").alias("n"))


@query(r"""WITH RECURSIVE t AS (SELECT conv_id % 10 AS session_id, row_number() OVER (PARTITION BY conv_id % 10 ORDER BY conv_id * 3600000 + turn * 60000, conv_id, turn) AS rn, ceil(length(text) / 4.0)::BIGINT AS n FROM conversations),
    s AS (SELECT session_id, 0::BIGINT AS rn, 0::BIGINT AS tokens, 0::BIGINT AS fired FROM (SELECT DISTINCT session_id FROM t) UNION ALL SELECT s.session_id, t.rn, CASE WHEN s.tokens + t.n >= 2000 THEN 0 ELSE s.tokens + t.n END, CASE WHEN s.tokens + t.n >= 2000 THEN s.fired + 1 ELSE s.fired END FROM s JOIN t ON t.session_id = s.session_id AND t.rn = s.rn + 1)
    SELECT session_id, arg_max(fired, rn) AS fired, arg_max(tokens, rn) AS tokens FROM s GROUP BY 1""")
def z2_compaction_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.completed(streaming.triggers(_stream(spark, sf_dir)), _folder(spark), "update").select("session_id", "fired", "tokens")


@query(f"""WITH x AS (SELECT 'sample' AS kind, unnest(range({len(rules.SAMPLES)})) AS id, unnest([{', '.join("'" + t.replace("'", "''") + "'" for t in rules.SAMPLES)}]) AS text
      UNION ALL SELECT 'document', doc_id, text FROM documents UNION ALL SELECT 'turn', conv_id * 1000 + turn, text FROM conversations)
    SELECT *, modality_mask <> 0 AS promoted FROM ({rules.masks_sql('x', 'kind, id')})""")
def d1_modality(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = spark.createDataFrame([("sample", i, t) for i, t in enumerate(rules.SAMPLES)], "kind string, id long, text string")
    docs = model.table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    turns = model.table(spark, sf_dir, "conversations").select(F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return samples.unionByName(docs).unionByName(turns).select("kind", "id", modality.mask(F.col("text")).alias("modality_mask")).withColumn("promoted", F.col("modality_mask") != 0)


@query()
def a3_authored_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = model.table(spark, sf_dir, "documents")
    front = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("---\ntitle: t\nhop_targets: [a, "), F.col("lang"), F.lit("]\n---\n"))).otherwise("")
    marked = F.concat(front, F.lit("# Head\n\n"), F.col("text"), F.lit("\n\n- always use it\n  more\n- second\n\n> quoted\n\n```\ncode\n```\n"))
    return authored.nodes(d.select(F.col("doc_id").cast("string").alias("source_doc"), marked.alias("text")))


def _notes(spark: SparkSession, sf_dir: str, late: bool) -> DataFrame:
    """Conversations as notes in files: at first their first two turns; later all turns, of which some change nothing, some files are too young to be taken, and some are gone."""
    c = model.table(spark, sf_dir, "conversations")
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.when((F.col("turn") < 2) | (F.lit(late) & (F.col("conv_id") % 3 != 0)), F.struct("turn", "text")))), lambda t: t["text"]), "\n\n")
    notes = c.groupBy("conv_id").agg(F.concat(F.lit("## Deep sleep\n- "), F.regexp_replace(said, "\\s+", " "), F.lit(" {score=0.7 recall="), F.max("turn").cast("string"), F.lit(" unique=2}")).alias("text"))
    notes = notes.select(F.concat(F.lit("n"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), "text", F.octet_length("text").cast("long").alias("size"), (F.lit(2000 if late else 1000) + F.when(F.col("conv_id") % 5 == 1, 900).otherwise(0)).cast("long").alias("mtime_ms"), "conv_id")
    return notes.where("conv_id % 7 <> 0").drop("conv_id") if late else notes.drop("conv_id")


def _followed(spark: SparkSession, sf_dir: str, parse) -> str:
    folder = f"{_folder(spark)}/notes-{uuid.uuid4().hex}"
    for late, now in ((False, 2500), (True, 2150), (True, 4000)):
        sync.follow(spark, lambda late=late: _notes(spark, sf_dir, late), folder, parse, clock=lambda now=now: now).awaitTermination()
    return folder


NOTES = r"""a AS (SELECT conv_id, '## Deep sleep' || chr(10) || '- ' || regexp_replace(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (turn < 2), '\s+', ' ', 'g') || ' {score=0.7 recall=' || max(turn) || ' unique=2}' AS old,
      '## Deep sleep' || chr(10) || '- ' || regexp_replace(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (turn < 2 OR conv_id % 3 <> 0), '\s+', ' ', 'g') || ' {score=0.7 recall=' || max(turn) || ' unique=2}' AS new FROM conversations GROUP BY conv_id)"""


@query(f"""WITH {NOTES} SELECT 'n' || conv_id || '.md' AS path, 0 AS epoch, 'new' AS change, sha256(old) AS digest FROM a WHERE old IS NOT NULL
    UNION ALL SELECT 'n' || conv_id || '.md', 1, 'gone', NULL FROM a WHERE conv_id % 7 = 0
    UNION ALL SELECT 'n' || conv_id || '.md', CASE WHEN conv_id % 5 = 1 THEN 2 ELSE 1 END, 'changed', sha256(new) FROM a WHERE conv_id % 7 <> 0 AND new <> old""")
def z3_followed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three ticks over a changing tree of notes see; a note that changed a moment ago is taken by the tick after."""
    folder = _followed(spark, sf_dir, lambda d: d.select("source_doc", F.length("text").alias("n")))
    return sync.log(spark, folder).select("path", "epoch", "change", "digest")


@query(f"""WITH {NOTES}, e AS (SELECT conv_id, trim(substr(new, 17, strpos(new, ' {{score=') - 17)) AS text, regexp_extract(new, 'recall=([0-9]+)', 1)::INT AS recall_count FROM a WHERE conv_id % 7 <> 0)
    SELECT 'n' || conv_id || '.md#dream#000000' AS id, text, 2 AS line, recall_count FROM e WHERE recall_count >= 2 AND octet_length(encode(text)) >= 16""")
def z4_followed_diaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The promoted entries of diaries that are followed in the same way."""
    folder = _followed(spark, sf_dir, lambda d: store.promoted(files.diary(d)))
    return sync.current(spark, folder).select("id", "text", "line", "recall_count")
