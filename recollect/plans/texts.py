"""Text functions and scans over documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions import text as T
from ..functions import vector as V
from .common import r6, registry, turns_sql

QUERIES, ORACLE_SQL, query = registry()


@query(r"""SELECT doc_id, ceil(length(text) / CASE WHEN regexp_matches(text, '[\x{4E00}-\x{9FAF}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{AC00}-\x{D7A3}]') THEN 1.6
      WHEN regexp_matches(text, '[\x{0400}-\x{04FF}\x{0590}-\x{05FF}\x{0600}-\x{06FF}]') THEN 2.5 ELSE 4.0 END)::BIGINT AS packed,
    greatest(length(text) // 4, 1) AS floored, greatest(ceil(length(text) / 4.0), 1)::BIGINT AS raised, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS words FROM documents""")
def tok_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return model.table(spark, sf_dir, "documents").select("doc_id", T.tokens_packed(t).alias("packed"), T.tokens_floor(t).alias("floored"), T.tokens_ceil(t).alias("raised"), T.tokens_words(t).alias("words"))


@query(r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: x <> '') AS t FROM documents)
    SELECT doc_id, len(t) AS n_terms, len(list_distinct(list_filter(t, lambda x: length(x) >= 3))) AS n_keywords FROM t""")
def f2_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A table written as one row group is read by one task, whatever its size: its texts are dealt over all before terms are searched for.
    d = model.table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id").select("doc_id", T.terms(F.col("text")).alias("terms"))
    return d.select("doc_id", F.size("terms").cast("long").alias("n_terms"), F.size(T.keywords_among(F.col("terms"))).cast("long").alias("n_keywords"))


@query("""SELECT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS attribute FROM documents""")
def f7_xml_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.table(spark, sf_dir, "documents").select("doc_id", T.xml_attribute(F.col("text")).alias("attribute"))


@query(r"""WITH t AS (SELECT doc_id, source, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents)
    SELECT doc_id, CASE WHEN length(flat) > 220 THEN substr(flat, 1, 220) || '…' ELSE flat END AS snippet, regexp_replace(source || ' / ' || doc_id, '[^a-zA-Z0-9._-]+', '_', 'g') AS file FROM t""")
def f14_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"), T.file_name(F.concat("source", F.lit(" / "), F.col("doc_id").cast("string"))).alias("file"))


@query(f"""WITH {turns_sql()}, w AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM turns),
    i AS (SELECT unnest(range(8)) AS i),
    h AS (SELECT id, i, sum(('0x' || substr(sha256(w), 2 * i + 1, 2))::INT / 127.5 - 1.0) AS x FROM w CROSS JOIN i GROUP BY id, i),
    n AS (SELECT id, sqrt(sum(x * x)) AS n FROM h GROUP BY id)
    SELECT h.id, h.i, round(x / n, 6) + 0.0 AS x FROM h JOIN n USING (id)""")
def f4_hashed_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.turns(spark, sf_dir).select("id", F.posexplode(V.hashed_embedding(F.col("text"), 8)).alias("i", "x")).select("id", "i", r6("x").alias("x"))


@query("""SELECT lang AS collection, doc_id AS id, length(text) AS n FROM documents WHERE lang = 'fr'""")
def s1_collection_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = model.table(spark, sf_dir, "documents").where("lang = 'fr'")
    return d.select(F.col("lang").alias("collection"), F.col("doc_id").alias("id"), F.length("text").cast("long").alias("n"))


@query("""SELECT doc_id, n_chars FROM documents WHERE lang = 'en' AND source = 'src3'""")
def s2_meta_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.table(spark, sf_dir, "documents").where("lang = 'en' and source = 'src3'").select("doc_id", "n_chars")


@query("""SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def s3_point_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.table(spark, sf_dir, "documents").select("doc_id", "lang").join(model.table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


@query("""SELECT DISTINCT 'lang:' || lang || ':' || source AS collection FROM documents""")
def s4_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.table(spark, sf_dir, "documents").select(F.concat_ws(":", F.lit("lang"), "lang", "source").alias("collection")).distinct()


@query("""SELECT count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE starts_with('lang:' || lang || ':' || source, 'lang:en:src1')""")
def s5_count_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = model.table(spark, sf_dir, "documents").where(F.concat_ws(":", F.lit("lang"), "lang", "source").startswith("lang:en:src1"))
    return d.agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(f"""WITH {turns_sql()} SELECT id, CASE WHEN role IN ('user', 'assistant', 'system') THEN trim(text || chr(10) || 'part ' || role, ' ' || chr(10)) END AS content FROM turns WHERE role IN ('user', 'assistant', 'system')""")
def s11_message_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    parts = F.array(part("text", F.col("text")), part("image", F.lit("left out")), part("input_text", F.concat(F.lit("part "), F.col("role"))))
    t = model.turns(spark, sf_dir).where(F.col("role").isin("user", "assistant", "system"))
    return t.select("id", T.content_text(parts).alias("content")).where("content <> ''")


@query("""SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE source END), ''), 'session-key:' || lang) AS ns FROM documents""")
def ns_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.col("source"))
    none = F.lit(None).cast("string")
    return model.table(spark, sf_dir, "documents").select("doc_id", model.namespace(user, F.col("lang"), none, none).alias("ns"))


@query("""WITH e AS (SELECT event_id, props ->> '$.k' AS a, CASE event_id % 4 WHEN 0 THEN event_id::VARCHAR WHEN 1 THEN '"' || value || '"' WHEN 2 THEN 'not a number' ELSE ' 7.5 ' END AS v FROM events)
    SELECT event_id, round(try_cast(regexp_replace(trim(v), '^"|"$', '', 'g') AS DOUBLE), 6) + 0.0 AS number FROM e""")
def f17_lenient_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    v = F.when(i % 4 == 0, i.cast("string")).when(i % 4 == 1, F.concat(F.lit('"'), F.col("value").cast("string"), F.lit('"'))).when(i % 4 == 2, "not a number").otherwise(" 7.5 ")
    return model.table(spark, sf_dir, "events").select("event_id", r6(T.number(v)).alias("number"))


@query("""SELECT doc_id, round((doc_id * 1000.0::DOUBLE) * n_chars / (1.2e11::DOUBLE * (1 + ln(doc_id % 10 + 1.0))) * 1e6, 6) + 0.0 AS priority FROM documents""")
def f16_eviction_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return model.table(spark, sf_dir, "documents").select("doc_id", r6(T.eviction_priority(d * 1000.0, F.col("n_chars"), d % 10) * 1e6).alias("priority"))


@query("""SELECT page_id, printf('%016x', list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(octet_length(encode(url))), lambda i: ('0x' || substr(hex(encode(url)), 2 * i + 1, 2))::UHUGEINT)),
    lambda h, b: ((xor(h, b) % 18446744073709551616::UHUGEINT) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT) AS digest FROM pages""")
def f11_fnv64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.table(spark, sf_dir, "pages").select("page_id", T.fnv64(F.col("url")).alias("digest"))
