"""Compaction of conversations dealt to ten long sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions import vector as V
from ..operators import compact
from . import modality as rules
from .common import r6, registry, turns_sql
from .sessions import tail_sql

QUERIES, ORACLE_SQL, query = registry()

SIZE = 8


def _dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = model.turns(spark, sf_dir, 10).withColumn("vector", V.hashed_embedding(F.col("text"), SIZE))
    return compact.older_buckets(t)


def summary_sql(pick: str, tag: str, text: str = "string_agg(text, ' ' ORDER BY ts_ms, id) FILTER (chosen)") -> str:
    """Summaries of the chosen turns (or another text of a bucket's), with their own vectors, as relations s, se and t with a tag behind their names."""
    return rf"""s{tag} AS (SELECT session_id, bucket, {text} AS text, 'summary:' || substr(sha256(session_id || ':' || string_agg(id || ',', '' ORDER BY ts_ms, id)), 1, 16) AS id,
      list(id ORDER BY ts_ms, id) AS ids, sum(tokens)::BIGINT AS source_tokens, count(*) AS turns FROM {pick} GROUP BY 1, 2 HAVING count(*) >= 2),
    sw{tag} AS (SELECT session_id, bucket, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS w FROM s{tag}),
    sh{tag} AS (SELECT session_id, bucket, i, sum(('0x' || substr(sha256(w), 2 * i + 1, 2))::INT / 127.5 - 1.0) AS x FROM sw{tag} CROSS JOIN (SELECT unnest(range({SIZE})) AS i) GROUP BY ALL),
    al{tag} AS (SELECT session_id, bucket, sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) AS align FROM sh{tag} JOIN m USING (session_id, bucket, i) GROUP BY 1, 2),
    cs{tag} AS (SELECT d.session_id, d.bucket, d.id, sum(h.x * e.x) / (sqrt(sum(h.x * h.x)) * sqrt(sum(e.x * e.x))) AS c FROM dealt d JOIN e USING (id) JOIN sh{tag} h ON h.session_id = d.session_id AND h.bucket = d.bucket AND h.i = e.i GROUP BY 1, 2, 3),
    cv{tag} AS (SELECT session_id, bucket, avg(greatest(c, 0)) AS cover FROM cs{tag} GROUP BY 1, 2),
    t{tag} AS (SELECT *, least(greatest((align + cover) / 2, 0), 1) AS confidence, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS token_count FROM s{tag} JOIN al{tag} USING (session_id, bucket) JOIN cv{tag} USING (session_id, bucket))"""


def _embed(text):
    return V.hashed_embedding(text, SIZE)


DEALT = rf"""{turns_sql('conv_id % 10')}, {tail_sql(4, 128)},
    old AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n, row_number() OVER (PARTITION BY session_id ORDER BY ts_ms, id) - 1 AS pos FROM split WHERE NOT recent),
    dealt AS (SELECT session_id, id, text, ts_ms, tokens, (pos * ceil(n / 20.0)::BIGINT // n) AS bucket FROM old WHERE n >= 2),
    w AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS w FROM dealt),
    h AS (SELECT id, i, sum(('0x' || substr(sha256(w), 2 * i + 1, 2))::INT / 127.5 - 1.0) AS x FROM w CROSS JOIN (SELECT unnest(range({SIZE})) AS i) GROUP BY id, i),
    e AS (SELECT id, i, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM h),
    m AS (SELECT session_id, bucket, i, avg(x) AS m FROM dealt JOIN e USING (id) GROUP BY 1, 2, 3),
    sim AS (SELECT d.session_id, d.bucket, d.id, any_value(d.text) AS text, any_value(d.ts_ms) AS ts_ms, any_value(d.tokens) AS tokens, sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) AS sim FROM dealt d JOIN e USING (id) JOIN m ON m.session_id = d.session_id AND m.bucket = d.bucket AND m.i = e.i GROUP BY 1, 2, 3),
    pick AS (SELECT *, row_number() OVER (PARTITION BY session_id, bucket ORDER BY round(sim, 9) DESC, ts_ms, id) <= ceil(count(*) OVER (PARTITION BY session_id, bucket) * 0.4) AS chosen FROM sim),
    {summary_sql('pick', '')}"""


@query(f"WITH {DEALT} SELECT session_id, bucket, id, round(sim, 6) + 0.0 AS sim, chosen FROM pick WHERE (session_id, bucket) IN (SELECT (session_id, bucket) FROM s)")
def x4_extractive_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact.extractive(_dealt(spark, sf_dir)).select("session_id", "bucket", "id", r6("sim").alias("sim"), "chosen")


@query(f"""WITH {DEALT} SELECT session_id, bucket, id, text, token_count, source_tokens, turns, round(confidence, 6) + 0.0 AS confidence, round(1 - confidence, 6) + 0.0 AS decay_rate, round(cover, 6) + 0.0 AS cover, token_count < source_tokens AS accepted FROM t""")
def x10_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = compact.summaries(_dealt(spark, sf_dir), embed=_embed)
    return s.select("session_id", "bucket", "id", "text", "token_count", "source_tokens", "turns", r6("confidence").alias("confidence"), r6("decay_rate").alias("decay_rate"), r6("cover").alias("cover"), "accepted")


@query(f"WITH {DEALT} SELECT session_id, id AS parent_summary_id, generate_subscripts(ids, 1) - 1 AS edge_order, unnest(ids) AS child_id, 'turn' AS child_type FROM t")
def x11_coverage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact.edges(compact.summaries(_dealt(spark, sf_dir), embed=_embed)).withColumn("edge_order", F.col("edge_order").cast("long"))


@query(f"""WITH {DEALT} SELECT session_id, count(*) FILTER (token_count < source_tokens) AS formed, count(*) FILTER (token_count >= source_tokens) AS declined, coalesce(sum(turns) FILTER (token_count < source_tokens), 0)::BIGINT AS turns_covered,
    round(avg(confidence) FILTER (token_count < source_tokens), 6) + 0.0 AS mean_confidence, CASE WHEN bool_or(token_count < source_tokens) THEN 'extractive' END AS method FROM t GROUP BY 1""")
def x12_compaction_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact.result(compact.summaries(_dealt(spark, sf_dir), embed=_embed)).withColumn("mean_confidence", r6("mean_confidence"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT doc_id AS p, c, c % 3 <> 0 AS inner_ FROM (SELECT doc_id, unnest([doc_id * 2 + 1, doc_id * 2 + 2]) AS c FROM documents)),
    x AS (SELECT doc_id AS root, c, inner_, 1 AS depth FROM documents JOIN e ON doc_id = p WHERE doc_id % 20 = 0 UNION ALL SELECT root, e.c, e.inner_, depth + 1 FROM x JOIN e ON x.c = e.p WHERE depth < 3 AND x.inner_)
    SELECT root, c AS child_id, depth FROM x WHERE NOT inner_ OR depth = 3""")
def r8_expand_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = model.table(spark, sf_dir, "documents").select("doc_id")
    e = d.select(F.col("doc_id").alias("parent_summary_id"), F.explode(F.array(F.col("doc_id") * 2 + 1, F.col("doc_id") * 2 + 2)).alias("child_id")).distinct()
    return compact.expanded(e.withColumn("child_type", F.when(F.col("child_id") % 3 == 0, "turn").otherwise("summary")), d.where("doc_id % 20 = 0").select(F.col("doc_id").alias("id")))


@query(f"""WITH {DEALT} SELECT session_id, bucket, round(align, 6) + 0.0 AS align, round(cover, 6) + 0.0 AS cover, round(confidence, 6) + 0.0 AS confidence FROM t""")
def x5_preservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = compact.summaries(_dealt(spark, sf_dir), embed=_embed)
    return q.select("session_id", "bucket", *[r6(c).alias(c) for c in ("align", "cover", "confidence")])


@query(f"""WITH {DEALT} SELECT session_id, bucket, count(*) AS turns, round(avg((length(text) % 100) / 100.0), 6) + 0.0 AS mean_gating, CASE WHEN round(avg((length(text) % 100) / 100.0), 9) >= 0.6 THEN 'abstractive' ELSE 'extractive' END AS route FROM pick GROUP BY 1, 2 HAVING count(*) >= 2""")
def x7_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dealt(spark, sf_dir).withColumn("gating_score", (F.length("text") % 100) / 100.0)
    return compact.routes(rows).withColumn("mean_gating", r6("mean_gating"))


@query(f"""WITH {DEALT}, pick1 AS (SELECT * REPLACE (row_number() OVER (PARTITION BY session_id, bucket ORDER BY round(sim, 9) DESC, ts_ms, id) <= ceil(count(*) OVER (PARTITION BY session_id, bucket) * 0.25) AS chosen) FROM pick),
    {summary_sql('pick1', '1')}
    SELECT t.session_id, t.bucket, CASE WHEN t.token_count >= t.source_tokens AND t1.token_count < t1.source_tokens THEN 1 ELSE 0 END AS step, t.token_count < t.source_tokens OR t1.token_count < t1.source_tokens AS accepted
    FROM t JOIN t1 ON t.session_id = t1.session_id AND t.bucket = t1.bucket""")
def x8_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every bucket the step that was taken; declined ones stay at the first."""
    from ..operators import protect

    return protect.ladder(_dealt(spark, sf_dir), embed=_embed).select("session_id", "bucket", "step", "accepted")


def _first_words(n: int) -> str:
    return rf"array_to_string(list_filter(regexp_split_to_array(string_agg(text, ' ' ORDER BY ts_ms, id), '\s+'), lambda x: x <> '')[1:{n}], ' ')"


@query(f"""WITH {DEALT}, pick1 AS (SELECT * REPLACE (row_number() OVER (PARTITION BY session_id, bucket ORDER BY round(sim, 9) DESC, ts_ms, id) <= ceil(count(*) OVER (PARTITION BY session_id, bucket) * 0.25) AS chosen) FROM pick),
    {summary_sql('pick1', '1')}, {summary_sql('pick', '64', _first_words(64))}, {summary_sql('pick', '32', _first_words(32))},
    g AS (SELECT session_id, bucket, round(avg((length(text) % 100) / 100.0), 9) >= 0.55 AS routed FROM pick GROUP BY 1, 2),
    tries AS (SELECT t.session_id, t.bucket, t.source_tokens, routed, unnest([0, 1, 2]) AS step,
        unnest([CASE WHEN routed AND t64.align >= 0.65 THEN 'abstractive' ELSE 'extractive' END, CASE WHEN routed AND t32.align >= 0.65 THEN 'abstractive' ELSE 'extractive' END, 'extractive']) AS method,
        unnest([CASE WHEN routed AND t64.align >= 0.65 THEN t64.text ELSE t.text END, CASE WHEN NOT routed THEN t1.text WHEN t32.align >= 0.65 THEN t32.text ELSE t.text END, t1.text]) AS text,
        unnest([CASE WHEN routed AND t64.align >= 0.65 THEN 0.8 * t64.confidence + 0.2 * 0.5 ELSE t.confidence END, CASE WHEN NOT routed THEN t1.confidence WHEN t32.align >= 0.65 THEN 0.8 * t32.confidence + 0.2 * 0.5 ELSE t.confidence END, t1.confidence]) AS confidence
      FROM t JOIN t1 USING (session_id, bucket) JOIN t64 USING (session_id, bucket) JOIN t32 USING (session_id, bucket) JOIN g USING (session_id, bucket)),
    tried AS (SELECT *, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) < source_tokens AS ok FROM tries WHERE routed OR step < 2)
    SELECT session_id, bucket, CASE WHEN routed THEN 'abstractive' ELSE 'extractive' END AS route, step, method, text, round(confidence, 6) + 0.0 AS confidence, ok AS accepted FROM tried
    QUALIFY row_number() OVER (PARTITION BY session_id, bucket ORDER BY ok DESC, step) = 1""")
def x6_routed_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets that the gate holds worth it go to a model, which here writes the first words it may; what is not aligned or not shorter falls back."""
    rows = _dealt(spark, sf_dir).withColumn("gating_score", (F.length("text") % 100) / 100.0 + 0.05)
    out = compact.escalated(rows, lambda texts, most: (" ".join(" ".join(texts).split()[:most]), 0.5), embed=_embed)
    return out.select("session_id", "bucket", "route", "step", "method", "text", r6("confidence").alias("confidence"), "accepted")


# Words of advice, and prototypes of advice that should survive.
HINTS = "prefer prioritise prioritize focus avoid reject keep ensure consider should must never do_not don't use"
PROTOTYPES = ["Prefer deterministic operational guidance over generic defaults.", "Avoid unsafe or undesired implementation choices in hot paths.", "Use the specified approach when implementing core project logic.", "Keep the implementation aligned with project-specific engineering rules."]


@query(rf"""WITH {turns_sql()}, t AS (SELECT id, role, CASE right(id, 1) WHEN '2' THEN 'Always use the harbour. ' || text WHEN '4' THEN 'They prefer deterministic operational guidance over generic defaults.' ELSE text END AS text FROM turns),
    a AS (SELECT id, text FROM t UNION ALL SELECT 'proto' || i, p FROM (SELECT unnest(range(4)) AS i, unnest([{', '.join(f"'{p}'" for p in PROTOTYPES)}]) AS p)),
    w AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS w FROM a),
    h AS (SELECT id, i, sum(('0x' || substr(sha256(w), 2 * i + 1, 2))::INT / 127.5 - 1.0) AS x FROM w CROSS JOIN (SELECT unnest(range(32)) AS i) GROUP BY ALL),
    v AS (SELECT id, list(x ORDER BY i) AS v FROM h GROUP BY id),
    n AS (SELECT t.id, max(list_cosine_similarity(t.v, p.v)) AS near FROM v t JOIN v p ON starts_with(p.id, 'proto') AND NOT starts_with(t.id, 'proto') GROUP BY 1),
    m AS ({rules.masks_sql('t', 'id')})
    SELECT t.id, CASE WHEN role <> 'user' OR trim(text) = '' THEN NULL WHEN modality_mask <> 0 THEN 'sigma'
      WHEN regexp_matches(lower(text), '\b(?:{'|'.join(h.replace('_', ' ').replace("'", "''") for h in HINTS.split())})\b') AND round(near, 9) >= 0.78 THEN 'booster' END AS protection FROM t JOIN m ON m.id = t.id LEFT JOIN n ON n.id = t.id""")
def x3_protection(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import protect, rank

    last = F.substring("id", -1, 1)
    said = F.when(last == "2", F.concat(F.lit("Always use the harbour. "), "text")).when(last == "4", "They prefer deterministic operational guidance over generic defaults.").otherwise(F.col("text"))
    t = model.turns(spark, sf_dir).withColumn("text", said)
    t = t.withColumn("vector", V.hashed_embedding(F.col("text"))).withColumn("stability_weight", rank.role_weight(F.col("role")))
    return protect.protected(t).select("id", "protection")


@query("""SELECT page_id, sha256(CASE WHEN length(html) >= 239 OR len(string_split(html, chr(10))) >= 8 THEN '[code block left out]' ELSE '```' || chr(10) || html || chr(10) || '```' END || chr(10) || 'tail') AS clean_sha FROM pages""")
def x9_sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import protect

    pages = model.table(spark, sf_dir, "pages")
    return pages.select("page_id", F.sha2(protect.sanitised(F.concat(F.lit("```\n"), "html", F.lit("\n```\ntail"))), 256).alias("clean_sha"))


@query(f"""WITH {turns_sql('conv_id % 10')}, r AS (SELECT *, sum(ceil(length(text) / 4.0)::BIGINT) OVER (PARTITION BY session_id ORDER BY ts_ms, id)::BIGINT AS running FROM turns)
    SELECT session_id, id, running, running // 2000 > (running - ceil(length(text) / 4.0)::BIGINT) // 2000 AS crosses FROM r""")
def x14_token_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    from ..functions import text as T
    from ..operators import session

    cost = T.tokens_packed(F.col("text"))
    t = model.turns(spark, sf_dir, 10).withColumn("n", cost).withColumn("running", F.sum("n").over(session.ordered().rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return t.select("session_id", "id", "running", (F.floor(F.col("running") / 2000) > F.floor((F.col("running") - F.col("n")) / 2000)).alias("crosses"))
