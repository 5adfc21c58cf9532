"""Session windows over conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions import text as T
from ..operators import session
from .common import r6, registry, turns_sql

QUERIES, ORACLE_SQL, query = registry()


def tail_sql(min_turns: int, budget: int) -> str:
    return f"""o AS (SELECT *, greatest(length(text) // 4, 1) AS tokens, row_number() OVER (PARTITION BY session_id ORDER BY ts_ms DESC, id DESC) AS back,
      lag(role) OVER (PARTITION BY session_id ORDER BY ts_ms, id) AS prev FROM turns),
    u AS (SELECT *, sum(tokens) OVER (PARTITION BY session_id ORDER BY ts_ms DESC, id DESC) AS used, sum(CASE WHEN back <= {min_turns} THEN tokens END) OVER (PARTITION BY session_id) AS base,
      sum(CASE WHEN (prev = 'user' AND role = 'assistant') OR (prev = 'assistant' AND role = 'user') THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY ts_ms, id)::BIGINT AS bundle FROM o),
    split AS (SELECT *, back <= {min_turns} AS in_base, bundle >= min(CASE WHEN back <= {min_turns} OR (base <= {budget} AND used <= {budget}) THEN bundle END) OVER (PARTITION BY session_id) AS recent FROM u)"""


def _split(spark: SparkSession, sf_dir: str, sessions: int | None, budget: int) -> DataFrame:
    t = model.turns(spark, sf_dir, sessions).withColumn("tokens", T.tokens_floor(F.col("text")))
    return session.tail_split(t, 4, budget).select("session_id", "id", "bundle", "in_base", "recent")


@query(f"WITH {turns_sql()}, {tail_sql(4, 128)} SELECT session_id, id, bundle, in_base, recent FROM split")
def w1_tail_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir, None, 128)


@query(f"WITH {turns_sql('conv_id % 10')}, {tail_sql(4, 4000)} SELECT session_id, id, bundle, in_base, recent FROM split")
def w1_tail_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir, 10, 4000)


BUCKETS = "b AS (SELECT *, (pos * ceil(n / 20.0)::BIGINT // n) AS bucket FROM (SELECT *, count(*) OVER (PARTITION BY session_id) AS n, row_number() OVER (PARTITION BY session_id ORDER BY ts_ms, id) - 1 AS pos FROM turns))"


@query(f"WITH {turns_sql('conv_id % 10')}, {BUCKETS} SELECT session_id, id, bucket FROM b")
def w2_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.buckets(model.turns(spark, sf_dir, 10)).select("session_id", "id", "bucket")


@query(f"""WITH {turns_sql('conv_id % 10')}, {BUCKETS} SELECT session_id, bucket, count(*) AS turns, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, round(avg(length(text)), 6) + 0.0 AS mean_chars, arg_min(user_ns, ts_ms * 100000 + user_ns) AS first_user FROM b GROUP BY 1, 2""")
def w4_cluster_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = session.buckets(model.turns(spark, sf_dir, 10))
    return b.groupBy("session_id", "bucket").agg(F.count("*").alias("turns"), F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), r6(F.avg(F.length("text"))).alias("mean_chars"), F.min_by("user_ns", F.col("ts_ms") * 100000 + F.col("user_ns")).alias("first_user"))


@query(f"""WITH RECURSIVE {turns_sql('conv_id % 10')}, {BUCKETS}, s AS (SELECT session_id, bucket AS k, min(ts_ms) AS start_ms, max(ts_ms) AS ts_ms, 's' || lpad(bucket::VARCHAR, 4, '0') AS id, 20 + (bucket * 17 + session_id) % 60 AS tokens FROM b GROUP BY 1, 2),
    p AS (SELECT c.session_id, c.k AS bucket, s.id, s.tokens, row_number() OVER (PARTITION BY c.session_id, c.k ORDER BY s.ts_ms DESC, s.id) AS rn FROM s c JOIN s ON c.session_id = s.session_id AND s.ts_ms < c.start_ms),
    f AS (SELECT session_id, bucket, 0::BIGINT AS rn, 0::BIGINT AS used, '' AS prior FROM (SELECT DISTINCT session_id, bucket FROM p)
      UNION ALL SELECT f.session_id, f.bucket, p.rn, CASE WHEN f.used + p.tokens <= 96 THEN f.used + p.tokens ELSE f.used END, CASE WHEN f.used + p.tokens <= 96 THEN p.id || CASE WHEN f.prior = '' THEN '' ELSE chr(10) || chr(10) || f.prior END ELSE f.prior END
      FROM f JOIN p ON p.session_id = f.session_id AND p.bucket = f.bucket AND p.rn = f.rn + 1)
    SELECT session_id, bucket, arg_max(used, rn) AS prior_tokens, arg_max(prior, rn) AS prior FROM f GROUP BY 1, 2""")
def w5_prior_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = session.buckets(model.turns(spark, sf_dir, 10)).groupBy("session_id", "bucket").agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("ts_ms"))
    name = F.concat(F.lit("s"), F.lpad(F.col("bucket").cast("string"), 4, "0"))
    s = b.select("session_id", "ts_ms", name.alias("id"), name.alias("text"), (20 + (F.col("bucket") * 17 + F.col("session_id")) % 60).alias("tokens"))
    return session.prior_context(b.select("session_id", "bucket", "start_ms"), s)


@query("""WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 256, 1), 256)) AS start FROM w)
    SELECT doc_id, start, least(512, len(w) - start) AS size FROM s""")
def w6_token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = model.table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", " ")).cast("long").alias("n"))
    s = d.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 257, F.lit(0)), F.lit(256).cast("long"))).alias("start"))
    return s.select("doc_id", "start", F.least(F.lit(512), F.col("n") - F.col("start")).alias("size"))


@query(f"WITH {turns_sql('conv_id % 10')}, {tail_sql(4, 128)} SELECT 'session_recall:' || session_id AS collection, 'recall:' || id AS id FROM split WHERE NOT recent")
def k13_recall_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = model.turns(spark, sf_dir, 10).withColumn("tokens", T.tokens_floor(F.col("text")))
    return session.recall_projection(t).select("collection", "id")


@query("""WITH w AS (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS w FROM documents), s AS (SELECT doc_id, unnest(range(0, greatest(len(w) - 256, 1), 256)) AS start FROM w),
    x AS (SELECT s.doc_id, start, unnest(list_filter(regexp_split_to_array(lower(array_to_string(w[start + 1:start + 512], ' ')), '\\s+'), lambda x: x <> '')) AS t FROM s JOIN w ON w.doc_id = s.doc_id),
    c AS (SELECT doc_id, start, t, count(*) AS n FROM x GROUP BY ALL), d AS (SELECT t, sha256(t) AS h FROM c GROUP BY t),
    h AS (SELECT doc_id, start, i, sum(n * (('0x' || substr(h, 2 * i + 1, 2))::INT / 127.5 - 1.0)) AS x FROM c JOIN d ON d.t = c.t CROSS JOIN (SELECT unnest(range(4)) AS i) GROUP BY ALL),
    v AS (SELECT doc_id, i, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id, start)) AS x FROM h)
    SELECT doc_id, i AS position, round(avg(x), 6) + 0.0 AS value, count(*) AS windows FROM v GROUP BY 1, 2""")
def w6_pooled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the vectors of each document's windows, entry by entry (texts without words have none in the SQL, and are left out)."""
    from ..functions import vector as V

    d = model.table(spark, sf_dir, "documents").where(r"text rlike '\\S'")
    p = session.pooled(d, "doc_id", lambda t: V.hashed_embedding(t, 4), 4)
    return p.select("doc_id", "n", F.posexplode("vector").alias("position", "value")).select("doc_id", F.col("position").cast("long").alias("position"), r6("value").alias("value"), F.col("n").alias("windows"))


@query(f"""WITH {turns_sql('conv_id % 10')}, {BUCKETS}, g AS (SELECT *, CASE WHEN role = 'user' THEN 'u' || user_ns END AS user_id, CASE WHEN length(text) % 7 > 0 THEN (length(text) % 300) / 100.0 END AS gate FROM b)
    SELECT session_id, bucket, count(*) AS turns, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, round(greatest(least(avg(coalesce(gate, 0)), 1), 0)::DOUBLE, 6) + 0.0 AS mean_gating, first(user_id ORDER BY ts_ms, id) FILTER (user_id IS NOT NULL) AS user_id FROM g GROUP BY 1, 2""")
def w4_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    t = model.turns(spark, sf_dir, 10).withColumn("user_id", F.when(F.col("role") == "user", F.concat(F.lit("u"), F.col("user_ns").cast("string")))).withColumn("gating_score", F.when(n % 7 > 0, (n % 300) / 100.0))
    return session.cluster_aggregates(session.buckets(t)).withColumn("mean_gating", r6("mean_gating"))
