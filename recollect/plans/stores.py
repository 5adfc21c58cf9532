"""Mutations and evaluation over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..operators import evaluate, retrieve, store
from .common import VECTORS_SQL, r6, registry, turns_sql

QUERIES, ORACLE_SQL, query = registry()


@query(f"""WITH {turns_sql()} SELECT 'session:' || session_id AS collection, id, false AS raw_history, true AS active_view FROM turns UNION ALL SELECT 'session_raw:' || session_id, id, true, false FROM turns""")
def k2_dual_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.dual_write(model.turns(spark, sf_dir)).select("collection", "id", "raw_history", "active_view")


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'new ' || lang ELSE source END AS source FROM documents UNION ALL SELECT 10000000 + doc_id, 'new ' || lang FROM documents WHERE doc_id % 50 = 0""")
def k9_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = model.table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    new = d.where("doc_id % 5 = 0").unionByName(d.where("doc_id % 50 = 0").withColumn("doc_id", F.col("doc_id") + 10_000_000)).select("doc_id", F.concat(F.lit("new "), "lang").alias("source"))
    return store.replaced(d.select("doc_id", "source"), new, ["doc_id"])


@query("""SELECT 'user:u' || (user_id % 40) AS collection, count(*) AS n FROM events WHERE NOT starts_with('user:u' || (user_id % 40), 'user:u1') GROUP BY 1""")
def k6_flush_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = model.table(spark, sf_dir, "events").select(F.concat(F.lit("user:u"), (F.col("user_id") % 40).cast("string")).alias("collection"))
    return store.flushed(e, "user:u1").groupBy("collection").agg(F.count("*").alias("n"))


@query("""WITH u AS (SELECT DISTINCT user_id AS id FROM events WHERE event_id % 3 = 0) SELECT vec_id AS id, label + CASE WHEN u.id IS NULL THEN 0 ELSE 1 END AS access_count FROM embeddings e LEFT JOIN u ON e.vec_id = u.id""")
def k8_access_bump(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = model.table(spark, sf_dir, "embeddings").select(F.lit("user").alias("collection"), F.col("vec_id").alias("id"), F.col("label").alias("access_count"))
    used = model.table(spark, sf_dir, "events").where("event_id % 3 = 0").select(F.lit("user").alias("collection"), F.col("user_id").alias("id"))
    return store.bumped(records, used).select("id", "access_count")


JOURNAL = "j AS (SELECT event_id AS id, user_id % 50 AS session_id, epoch_ms(ts) AS ts_ms, event_type AS hook FROM events)"


def _journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 50).alias("session_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("event_type").alias("hook"))


@query(f"WITH {JOURNAL} SELECT id, session_id, hook FROM j ORDER BY ts_ms DESC, id DESC LIMIT 500")
def k10_journal_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.journal_pruned(_journal(spark, sf_dir), 500).select("id", "session_id", "hook")


@query(f"WITH {JOURNAL} SELECT session_id, id, hook FROM j QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts_ms DESC, id DESC) <= 20")
def k10_journal_by_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.journal_pruned(_journal(spark, sf_dir), 20, F.col("session_id")).select("session_id", "id", "hook")


@query(f"WITH {JOURNAL} SELECT id, hook FROM j WHERE session_id = 7 ORDER BY id LIMIT 25")
def k11_journal_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _journal(spark, sf_dir).where("session_id = 7").orderBy("id").limit(25).select("id", "hook")


@query("""WITH e AS (SELECT 'conv' || conv_id AS source_doc, turn AS line, text, (turn % 10) / 10.0 + 0.3 AS score, conv_id % 4 AS recall_count, turn % 5 AS unique_queries FROM conversations)
    SELECT source_doc || '#dream#' || lpad((row_number() OVER (PARTITION BY source_doc ORDER BY line) - 1)::VARCHAR, 6, '0') AS id, line FROM e WHERE octet_length(encode(trim(text))) >= 16 AND score >= 0.6 AND recall_count >= 2 AND unique_queries >= 2""")
def k12_dream_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = model.table(spark, sf_dir, "conversations").select(F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("source_doc"), F.col("turn").alias("line"), "text", ((F.col("turn") % 10).cast("decimal(10,1)") / 10 + F.lit(0.3).cast("decimal(2,1)")).alias("score"), (F.col("conv_id") % 4).alias("recall_count"), (F.col("turn") % 5).alias("unique_queries"))
    return store.promoted(e).select("id", "line")


@query("""SELECT '{"collection":"' || lang || ':' || source || '","id":' || doc_id || ',"text":"' || lang || '","metadata":{"n_chars":"' || n_chars || '","source":"' || source || '"}}' AS value FROM documents WHERE lang = 'fr'""")
def k7_export_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = model.table(spark, sf_dir, "documents").select(F.concat_ws(":", "lang", "source").alias("collection"), F.col("doc_id").alias("id"), F.col("lang").alias("text"), F.create_map(F.lit("n_chars"), F.col("n_chars").cast("string"), F.lit("source"), F.col("source")).alias("metadata"))
    return store.exported(d, "fr")


@query("""WITH r AS (SELECT CASE WHEN d.doc_id % 9 = 0 THEN lang || '_abs' ELSE lang END AS question_type, l.quality = 1 AS session_hit, l.toxic = 0 AS answer_hit, n_chars AS prompt_tokens FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
    SELECT question_type, count(*) AS n, round(avg(session_hit::INT), 6) + 0.0 AS session_rate, round(avg(answer_hit::INT), 6) + 0.0 AS answer_rate, round(avg(prompt_tokens), 6) + 0.0 AS mean_tokens FROM r WHERE NOT ends_with(question_type, '_abs') GROUP BY GROUPING SETS ((question_type), ())""")
def e1_hit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = model.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(model.table(spark, sf_dir, "labels"), "doc_id")
    kind = F.when(F.col("doc_id") % 9 == 0, F.concat("lang", F.lit("_abs"))).otherwise(F.col("lang"))
    out = evaluate.hit_rates(d.select(kind.alias("question_type"), (F.col("quality") == 1).alias("session_hit"), (F.col("toxic") == 0).alias("answer_hit"), F.col("n_chars").alias("prompt_tokens")))
    return out.select("question_type", "n", *[r6(c).alias(c) for c in ("session_rate", "answer_rate", "mean_tokens")])


@query(f"""WITH {VECTORS_SQL}, s AS (SELECT q.id AS query_id, v.id, q.collection = v.collection AS rel, list_cosine_similarity(q.vector, v.vector) AS score FROM v q JOIN v ON q.id % 20 = 0 AND q.id <> v.id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s),
    g AS (SELECT query_id, count(*) FILTER (rel) AS relevant, count(*) FILTER (rel AND rank <= 1) AS n1, count(*) FILTER (rel AND rank <= 3) AS n3, count(*) FILTER (rel AND rank <= 8) AS n8, min(rank) FILTER (rel AND rank <= 8) AS best FROM r GROUP BY 1)
    SELECT query_id, round(n1 / least(relevant, 1), 6) + 0.0 AS recall_1, round(n3 / least(relevant, 3), 6) + 0.0 AS recall_3, round(n8 / least(relevant, 8), 6) + 0.0 AS recall_8, round(coalesce(1.0 / best, 0)::DOUBLE, 6) + 0.0 AS mrr FROM g WHERE relevant > 0""")
def e2_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = model.vectors(spark, sf_dir)
    q = v.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector", F.col("collection").alias("of"))
    ranked = retrieve.top_k(v, q.select("query_id", "vector"), 8)
    return evaluate.recall_by_collection(ranked, q.select("query_id", F.col("of").alias("collection")), v).select("query_id", *[r6(c).alias(c) for c in ("recall_1", "recall_3", "recall_8", "mrr")])


@query("""WITH r AS (SELECT quality = 1 AS e, doc_id % 7 <> 0 AS g FROM labels) SELECT round(count(*) FILTER (NOT e AND g) / count(*) FILTER (NOT e), 6) + 0.0 AS fp, round(count(*) FILTER (e AND NOT g) / count(*) FILTER (e), 6) + 0.0 AS fn FROM r""")
def e3_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model.table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("expected"), (F.col("doc_id") % 7 != 0).alias("got"))
    return evaluate.error_rates(rows).select(r6("fp").alias("fp"), r6("fn").alias("fn"))


@query("""SELECT t AS threshold, count(*) FILTER ((doc_id % 100) / 100.0 >= t) AS reached, count(*) AS n FROM labels CROSS JOIN (SELECT unnest([0.65, 0.75, 0.85])::DOUBLE AS t) GROUP BY 1""")
def e5_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.sweep(model.table(spark, sf_dir, "labels").select(((F.col("doc_id") % 100) / 100.0).alias("value")))


@query("""WITH r AS (SELECT lang, quality = 1 AS w, d.doc_id % 4 <> 0 AS s FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
    SELECT lang, count(*) FILTER (w) AS wanted, count(*) FILTER (w AND s) AS kept, count(*) FILTER (NOT w AND s) AS false_kept, count(*) FILTER (w AND NOT s) AS missed, round(count(*) FILTER (NOT w AND s) / nullif(count(*) FILTER (w), 0), 6) + 0.0 AS p_fp FROM r GROUP BY 1""")
def e4_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = model.table(spark, sf_dir, "documents").select("doc_id", "lang").join(model.table(spark, sf_dir, "labels"), "doc_id")
    out = evaluate.survival(d.select("lang", (F.col("quality") == 1).alias("wanted"), (F.col("doc_id") % 4 != 0).alias("survived")), ["lang"])
    return out.withColumn("p_fp", r6("p_fp"))


@query(r"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, lower(text) AS low FROM documents), t AS (SELECT DISTINCT r, unnest(regexp_split_to_array(low, '[^a-z0-9_]+')) AS w FROM d),
    a AS (SELECT item_id, lower(text) AS low FROM benchmark), k AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(low, '[^a-z0-9_]+'), lambda x: length(x) >= 3)) AS w FROM a),
    p AS (SELECT item_id, r FROM a JOIN d ON contains(d.low, a.low)), s AS (SELECT DISTINCT item_id, r FROM k JOIN t ON t.w = k.w),
    n AS (SELECT a.item_id, (SELECT count(*) FROM d) AS n, (SELECT count(*) FROM p WHERE p.item_id = a.item_id) AS present, (SELECT count(*) FROM s WHERE s.item_id = a.item_id AND NOT EXISTS (SELECT 1 FROM p WHERE p.item_id = s.item_id AND p.r = s.r)) AS related FROM a),
    c AS (SELECT item_id, unnest(['answer_present', 'related', 'none']) AS miss, unnest([present, related, n - present - related]) AS n FROM n)
    SELECT item_id, miss, n FROM c WHERE n > 0""")
def e6_miss_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items and their whole texts against all documents."""
    answers = model.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("answer"))
    return evaluate.miss_counts(answers, model.table(spark, sf_dir, "documents"))


@query(f"""WITH {VECTORS_SQL}, s AS (SELECT q.id AS query_id, v.id, q.collection = v.collection AS rel, n, list_cosine_similarity(q.vector[1:n], v.vector[1:n]) AS score FROM v q JOIN v ON q.id % 20 = 0 AND q.id <> v.id CROSS JOIN (SELECT unnest([16, 64]) AS n) t),
    f AS (SELECT query_id, n FROM (SELECT *, row_number() OVER (PARTITION BY query_id, n ORDER BY round(score, 9) DESC, id) AS rank FROM s) WHERE rank = 1 AND NOT rel),
    c AS (SELECT query_id, bool_or(n = 16) AS a, bool_or(n = 64) AS b FROM f GROUP BY 1)
    SELECT count(*) FILTER (a) AS "first", count(*) FILTER (b) AS "second", count(*) FILTER (a AND b) AS common, round(coalesce(count(*) FILTER (a AND b)::DOUBLE / nullif(count(*), 0), 1.0), 6) + 0.0 AS jaccard FROM c""")
def e2_failure_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At which queries short and whole vectors both put a record of another collection first."""
    v = model.vectors(spark, sf_dir)
    q = v.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector", F.col("collection").alias("of"))
    top = retrieve.top_k(v, q.select("query_id", "vector"), 1, sizes=(16, 64)).join(q.select("query_id", "of"), "query_id").where("collection <> of")
    out = evaluate.failure_jaccard(top.where("tier = 1"), top.where("tier = 2"))
    return out.select("first", "second", "common", r6("jaccard").alias("jaccard"))


@query("""SELECT 'user:u' || (user_id % 40) AS collection, count(*) AS n FROM events WHERE NOT starts_with('user:u' || (user_id % 40), 'user:u3') GROUP BY 1""")
def k5_delete_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = model.table(spark, sf_dir, "events").select(F.concat(F.lit("user:u"), (F.col("user_id") % 40).cast("string")).alias("collection"))
    return store.without_collections(e, "user:u3").groupBy("collection").agg(F.count("*").alias("n"))


_NODES = """n AS (SELECT 'd' || doc_id AS source_doc, unnest(range(len(l))) AS ordinal, unnest(l) AS text, doc_id FROM (SELECT doc_id, string_split(text, chr(10))[1:{most}] AS l FROM documents WHERE {which})),
    r AS (SELECT CASE ordinal % 3 WHEN 1 THEN 'authored:hard' WHEN 2 THEN 'authored:soft' ELSE 'authored:variant' END AS collection, source_doc || '#' || lpad(ordinal::VARCHAR, 6, '0') AS id, text, CASE WHEN ordinal % 3 = 0 THEN 8 ELSE 1 END AS size FROM n)"""


@query(f"""SELECT * FROM (WITH {_NODES.format(most=4, which='doc_id % 4 <> 0')} SELECT * FROM r) UNION ALL SELECT * FROM (WITH {_NODES.format(most=2, which='doc_id % 4 = 0')} SELECT * FROM r)
    UNION ALL SELECT 'user:u' || doc_id % 5, 'x' || doc_id, 'a note', 8 FROM documents""")
def k9_authored_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines as nodes of the three tiers, of every fourth document anew; a user's records of the same documents stay."""
    from ..functions import vector as V

    d = model.table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_doc"), "text", "doc_id")

    def records(docs: DataFrame, most: int) -> DataFrame:
        lines = docs.select("source_doc", F.posexplode(F.slice(F.split("text", "\n", -1), 1, most)).alias("ordinal", "text"))
        return store.authored_records(lines.withColumn("tier", F.col("ordinal") % 3), lambda t: V.hashed_embedding(t, 8)).select("source_doc", "collection", "id", "text", "vector")

    own = d.select("source_doc", F.concat(F.lit("user:u"), (F.col("doc_id") % 5).cast("string")).alias("collection"), F.concat(F.lit("x"), F.col("doc_id").cast("string")).alias("id"), F.lit("a note").alias("text"), F.array_repeat(F.lit(1.0), 8).alias("vector"))
    changed = d.where("doc_id % 4 = 0")
    out = store.authored_replaced(records(d, 4).unionByName(own), changed, records(changed, 2))
    return out.select("collection", "id", "text", F.size("vector").alias("size"))
