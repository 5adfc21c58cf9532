"""Vector retrieval over ``embeddings``: every vector whose id is divisible by 20 is a query against all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions import vector as V
from ..operators import index, retrieve
from .common import VECTORS_SQL, r6, registry

QUERIES, ORACLE_SQL, query = registry()


def _queries(v: DataFrame) -> DataFrame:
    return v.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")


SCORED = f"""{VECTORS_SQL}, s AS (SELECT q.id AS query_id, v.id, v.collection, list_cosine_similarity(q.vector, v.vector) AS score
    FROM v q JOIN v ON q.id % 20 = 0 AND q.id <> v.id)"""


@query(f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s)
    SELECT query_id, rank, id, round(score, 6) + 0.0 AS score FROM r WHERE rank <= 10""")
def r1_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = model.vectors(spark, sf_dir)
    return retrieve.top_k(v, _queries(v), 10).select("query_id", F.col("rank").cast("long").alias("rank"), "id", r6("score").alias("score"))


@query(f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s)
    SELECT query_id, rank, id, collection, split_part(collection, ':', 1) AS scope FROM r WHERE rank <= 5""")
def r2_annotated_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = model.vectors(spark, sf_dir)
    return retrieve.top_k(v, _queries(v), 5).select("query_id", F.col("rank").cast("long").alias("rank"), "id", "collection", model.scope(F.col("collection")).alias("scope"))


@query(f"""WITH {SCORED}, c AS (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY round(score, 9) DESC, id) AS pos FROM s WHERE collection IN ('label:0', 'label:1', 'label:2')),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, collection, id) AS rank FROM c WHERE pos <= 8)
    SELECT query_id, rank, id, collection, round(score, 6) + 0.0 AS score FROM r WHERE rank <= 8""")
def r3_multi_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = model.vectors(spark, sf_dir)
    some = v.where(F.col("collection").isin("label:0", "label:1", "label:2"))
    return retrieve.top_k_over_collections(some, _queries(v), 8).select("query_id", F.col("rank").cast("long").alias("rank"), "id", "collection", r6("score").alias("score"))


@query(f"""WITH {SCORED}, x AS (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY round(score, 9) DESC, id) AS pos FROM s),
    k AS (SELECT * FROM x WHERE NOT (pos <= 3 AND (collection = 'label:0' OR query_id % 40 = 0))),
    c AS (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY round(score, 9) DESC, id) AS place FROM k),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, collection, id) AS rank FROM c WHERE place <= 8)
    SELECT query_id, rank, id, collection, round(score, 6) + 0.0 AS score FROM r WHERE rank <= 8""")
def r3_search_with_excludes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All collections, without what a first search found: each query's three best of one collection, and of all collections for every second query. No place is lost to what is left out."""
    v = model.vectors(spark, sf_dir)
    seen = retrieve.top_k(v, _queries(v), 3, per_collection=True).where("collection = 'label:0' or query_id % 40 = 0")
    found = retrieve.top_k_over_collections(v, _queries(v), 8, seen.select("query_id", "collection", "id"))
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "id", "collection", r6("score").alias("score"))


@query(f"""WITH {SCORED.replace("q.id % 20 = 0 AND ", "")}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s)
    SELECT query_id, rank, id, round(score, 6) + 0.0 AS score FROM r WHERE rank <= 3""")
def r1_all_against_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest of every vector: both sides are large, so they meet by tiles."""
    v = model.vectors(spark, sf_dir)
    return retrieve.top_k(v, v.select(F.col("id").alias("query_id"), "vector"), 3).select("query_id", F.col("rank").cast("long").alias("rank"), "id", r6("score").alias("score"))


@query()
def r1_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest by the inverted file."""
    v = model.vectors(spark, sf_dir)
    fitted = index.fit(v)
    return index.search(index.indexed(v, fitted), fitted, _queries(v)).select("query_id", "rank", "id", r6("score").alias("score"))


@query(f"""WITH {VECTORS_SQL}, t AS (SELECT unnest([1, 2, 3]) AS tier, unnest([16, 32, 64]) AS size),
    s AS (SELECT q.id AS query_id, v.id, tier, list_cosine_similarity(q.vector[1:size], v.vector[1:size]) AS score FROM v q JOIN v ON q.id % 20 = 0 AND q.id <> v.id CROSS JOIN t),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id, tier ORDER BY round(score, 9) DESC, id) AS rank, max(score) OVER (PARTITION BY query_id, tier) AS best FROM s),
    p AS (SELECT *, min(tier) OVER (PARTITION BY query_id) AS first FROM r WHERE rank <= 10 AND round(best, 9) >= CASE tier WHEN 1 THEN 0.65 WHEN 2 THEN 0.75 ELSE -2 END)
    SELECT query_id, tier, rank, id, round(score, 6) + 0.0 AS score FROM p WHERE tier = first""")
def r4_prefix_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = model.vectors(spark, sf_dir)
    return retrieve.cascade(v, _queries(v)).select("query_id", "tier", F.col("rank").cast("long").alias("rank"), "id", r6("score").alias("score"))


@query(f"""WITH {VECTORS_SQL}, c AS (SELECT id, vector[1:16] AS p FROM v), n AS (SELECT id, p, sqrt(list_sum(list_transform(p, lambda x: x * x))) AS n FROM c)
    SELECT id, round(p[1] / n, 6) + 0.0 AS first, round(list_sum(list_transform(p, lambda x: x / n)), 6) + 0.0 AS total, len(p) AS size FROM n""")
def r5_prefix_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = model.vectors(spark, sf_dir).select("id", V.prefix(F.col("vector"), 16).alias("p"))
    return p.select("id", r6(F.col("p")[0]).alias("first"), r6(F.aggregate("p", F.lit(0.0), lambda s, x: s + x)).alias("total"), F.size("p").cast("long").alias("size"))


@query(f"""WITH {VECTORS_SQL}, t AS (SELECT id, unnest([64, 256]) AS tier FROM v) SELECT id, tier FROM t WHERE NOT (tier = 64 AND id % 3 <> 0)""")
def k15_missing_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import store

    v = model.vectors(spark, sf_dir)
    have = v.where("id % 3 <> 0").select("id", F.lit(64).alias("tier"))
    return store.missing_tiers(v, have)


@query("""SELECT 'global:' || lang || '::' || doc_id AS plain, replace(replace('label ' || lang, ' ', '%20'), ':', '%3A') || '::' || doc_id AS path,
    len(string_split(text, chr(10))) AS end_line, 'memory' AS source FROM documents""")
def r10_result_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = model.table(spark, sf_dir, "documents").select(F.concat(F.lit("label "), F.col("lang")).alias("collection"), F.col("doc_id").alias("id"), "text", "lang")
    return retrieve.shaped(d).select(F.concat(F.lit("global:"), "lang", F.lit("::"), F.col("id").cast("string")).alias("plain"), "path", F.col("end_line").cast("long").alias("end_line"), "source")


@query("""SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS lines FROM documents""")
def r11_line_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.table(spark, sf_dir, "documents").select("doc_id", retrieve.line_range(F.col("text"), 2, 3).alias("lines"))


@query(r"""SELECT conv_id, turn, regexp_matches(lower(text), '\bdream(?:s|ed|ing)?\b') AS dream FROM conversations""")
def r12_dream_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.table(spark, sf_dir, "conversations").select("conv_id", "turn", retrieve.asks_for_dreams(F.col("text")).alias("dream"))


@query("""WITH m AS (SELECT conv_id AS session_id, turn, CASE WHEN turn % 3 = 0 THEN NULL WHEN turn % 7 = 1 THEN '' ELSE conv_id || '-' || turn END AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
    SELECT session_id, id FROM m WHERE back <= 4 AND id <> ''""")
def r13_recent_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = model.table(spark, sf_dir, "conversations")
    mid = F.when(F.col("turn") % 3 == 0, F.lit(None)).when(F.col("turn") % 7 == 1, "").otherwise(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return retrieve.recent_ids(c.select(F.col("conv_id").alias("session_id"), mid.alias("id"), F.col("turn").alias("ts_ms"), F.col("turn").alias("position")))


@query(r"""WITH r AS (SELECT conv_id * 1000 + turn AS request_id, CASE WHEN turn % 4 = 0 THEN text ELSE '' END AS query, CASE WHEN turn % 4 = 1 THEN 'What did I DREAM of' END AS text, CASE WHEN turn % 4 = 2 THEN 'dreamy input' END AS input, CASE WHEN turn % 5 <> 0 THEN text END AS q,
      CASE WHEN turn % 2 = 0 THEN turn - 1 END AS k, CASE WHEN turn % 3 = 0 THEN 5.7 ELSE -1.0 END::DOUBLE AS "limit", turn AS top_k, CASE WHEN turn % 6 <> 0 THEN 's' || conv_id END AS session_id, 'u' || conv_id % 20 AS user_ns FROM conversations),
    f AS (SELECT *, coalesce(nullif(query, ''), nullif(text, ''), nullif(input, ''), nullif(q, '')) AS asked FROM r)
    SELECT request_id, asked AS query, coalesce(CASE WHEN k > 0 THEN k END, CASE WHEN "limit" > 0 THEN greatest(floor("limit"), 1) END, CASE WHEN top_k > 0 THEN top_k END, 8)::INT AS k, regexp_matches(asked, '(?i)\bdream(?:s|ed|ing)?\b') AS dream,
    CASE WHEN regexp_matches(asked, '(?i)\bdream(?:s|ed|ing)?\b') THEN 'dream:' || user_ns ELSE concat_ws(',', 'session:' || session_id, 'user:' || user_ns, 'global') END AS collections FROM f WHERE asked IS NOT NULL""")
def r9_search_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, turn = model.table(spark, sf_dir, "conversations"), F.col("turn")
    asked = c.select(
        (F.col("conv_id") * 1000 + turn).alias("request_id"), F.when(turn % 4 == 0, F.col("text")).otherwise("").alias("query"), F.when(turn % 4 == 1, "What did I DREAM of").alias("_text"), F.when(turn % 4 == 2, "dreamy input").alias("input"), F.when(turn % 5 != 0, F.col("text")).alias("q"),
        F.when(turn % 2 == 0, turn - 1).alias("k"), F.when(turn % 3 == 0, 5.7).otherwise(-1.0).alias("limit"), turn.alias("top_k"), F.when(turn % 6 != 0, F.concat(F.lit("s"), F.col("conv_id").cast("string"))).alias("session_id"), F.concat(F.lit("u"), (F.col("conv_id") % 20).cast("string")).alias("user_ns"),
    )
    return retrieve.requests(asked.withColumnRenamed("_text", "text")).withColumn("collections", F.array_join("collections", ","))


@query(f"""WITH {VECTORS_SQL}, t AS (SELECT unnest([0, 16, 32, 100]) AS n), x AS (SELECT CASE WHEN n = 0 THEN collection ELSE collection || ':' || n || 'd' END AS collection, id, n, CASE WHEN n = 0 THEN vector WHEN n <= len(vector) THEN vector[1:n] END AS p FROM v CROSS JOIN t)
    SELECT collection, id, p IS NULL AS dirty, len(p) AS size, round(CASE WHEN n = 0 THEN list_sum(p) ELSE list_sum(p) / sqrt(list_sum(list_transform(p, lambda y: y * y))) END, 6) + 0.0 AS total FROM x""")
def r6_three_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import store

    out = store.in_tiers(model.vectors(spark, sf_dir), (16, 32, 100))
    return out.select("collection", "id", "dirty", F.when(~F.col("dirty"), F.size("vector")).cast("long").alias("size"), r6(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query(f"""WITH {VECTORS_SQL}, c AS (SELECT id, vector[1:16] AS p FROM v), n AS (SELECT id, p, sqrt(list_sum(list_transform(p, lambda x: x * x))) AS n FROM c)
    SELECT id, unnest(range(16)) AS position, round(unnest(p) / n, 6) + 0.0 AS value FROM n""")
def r5_prefix_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = model.vectors(spark, sf_dir).select("id", F.posexplode(V.prefix(F.col("vector"), 16)).alias("position", "value"))
    return p.select("id", F.col("position").cast("long").alias("position"), r6("value").alias("value"))
