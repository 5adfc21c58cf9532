"""Single functions and sources over the driver's tables, each with SQL of its own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions import text as T
from ..functions import vector as V
from ..operators import assemble, pack, protect, retrieve, store, temporal
from ..sources import files
from .common import VECTORS_SQL, r6, registry, turns_sql
from .streams import _folder

QUERIES, ORACLE_SQL, query = registry()


@query("""SELECT doc_id, (doc_id % 2 = 0) AND CASE WHEN doc_id % 3 = 0 THEN n_chars % 6 = 2 WHEN doc_id % 5 < 3 THEN n_chars % 6 BETWEEN 1 AND 4 ELSE false END AS applies FROM documents""")
def c15_selector_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return model.table(spark, sf_dir, "documents").select("doc_id", temporal.selector_applies(i % 2 == 0, i % 3 == 0, i % 5 < 3, F.col("n_chars") % 6).alias("applies"))


@query("""SELECT item_id // 10 AS query_id, sum(ceil(length(text) / 4.0))::BIGINT AS reserved FROM benchmark GROUP BY 1""")
def p8_startup_reserve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the hard items of each scope cost; a reserve beyond a million tokens would fail."""
    costs = model.table(spark, sf_dir, "benchmark").select(F.floor(F.col("item_id") / 10).alias("query_id"), F.ceil(F.length("text") / 4).alias("tokens"))
    return pack.reserve_checked(costs, 1_000_000)


@query(f"""WITH {VECTORS_SQL}, e AS (SELECT collection, unnest(range(64)) AS position, unnest(vector) AS x FROM v)
    SELECT collection, position, round(avg(x), 6) + 0.0 AS value, count(*) AS n FROM e GROUP BY 1, 2""")
def f5_mean_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = V.mean_by(model.vectors(spark, sf_dir), ["collection"], "vector", 64)
    return m.select("collection", "n", F.posexplode("mean").alias("position", "value")).select("collection", F.col("position").cast("long").alias("position"), r6("value").alias("value"), "n")


@query(f"""WITH {VECTORS_SQL}, t AS (SELECT id, unnest(range(4)) AS k, vector FROM v), s AS (SELECT id, vector[16 * k + 1:16 * k + 16] AS x FROM t WHERE (id >> k) % 2 = 1),
    e AS (SELECT id, unnest(range(16)) AS position, unnest(x) AS x FROM s), m AS (SELECT id, position, avg(x) AS x FROM e GROUP BY 1, 2)
    SELECT v.id, p.position, round(coalesce(m.x, 0), 6) + 0.0 AS value FROM v CROSS JOIN (SELECT unnest(range(16)) AS position) p LEFT JOIN m ON m.id = v.id AND m.position = p.position""")
def f6_masked_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as four token states of 16, of which a mask by the id's bits counts some."""
    states = F.array(*[F.slice("vector", 16 * k + 1, 16) for k in range(4)])
    mask = F.array(*[F.shiftright("id", k) % 2 == 1 for k in range(4)])
    v = model.vectors(spark, sf_dir).select("id", states.alias("s"), mask.alias("m"))
    return v.select("id", F.posexplode(V.masked_mean(F.col("s"), F.col("m"))).alias("position", "value")).select("id", F.col("position").cast("long").alias("position"), r6("value").alias("value"))


@query(f"""WITH {turns_sql()}, r AS (SELECT id, text, CASE WHEN ts_ms // 60000 % 3 > 0 THEN role END AS role, CASE WHEN ts_ms // 60000 % 2 = 0 THEN 'user:u' || user_ns ELSE 'global' END AS collection, CASE WHEN ts_ms // 60000 % 5 = 0 THEN 'u' || user_ns END AS user_id FROM turns)
    SELECT id, '<entry speaker="' || CASE WHEN role IN ('user', 'assistant', 'system') THEN role WHEN starts_with(collection, 'user:') OR starts_with(collection, 'turns:') OR user_id IS NOT NULL THEN 'user' ELSE 'unknown' END
      || '" source="recalled">' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</entry>' AS entry FROM r""")
def f8_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    minute = F.floor(F.col("ts_ms") / 60000)
    role, user = F.when(minute % 3 > 0, F.col("role")), F.concat(F.lit("u"), F.col("user_ns").cast("string"))
    speaker = assemble.role_of(role, F.when(minute % 2 == 0, F.concat(F.lit("user:"), user)).otherwise("global"), F.when(minute % 5 == 0, user))
    return model.turns(spark, sf_dir).select("id", assemble.tagged(F.col("text"), speaker, "recalled").alias("entry"))


@query(r"""SELECT doc_id, sha256(trim(regexp_replace(text, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g'))) AS line_sha FROM documents""")
def f13_one_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.one_line(F.col("text")), 256).alias("line_sha"))


@query("""SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9._-]+', '_', 'g') AS name FROM pages""")
def f15_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.table(spark, sf_dir, "pages").select("page_id", T.file_name(F.col("url")).alias("name"))


@query(r"""WITH l AS (SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN string_split(text || chr(10) || 'see #' || lang, chr(10)) ELSE string_split(text, chr(10)) END AS l FROM documents)
    SELECT doc_id, doc_id % 3 = 0 OR len(list_filter(l, lambda x: NOT starts_with(ltrim(x, E' \t'), '#') AND regexp_matches(x, '(^|\s)#[A-Za-z]'))) > 0 AS eligible FROM l""")
def s7_eligible_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes: with frontmatter, with a tag inside a fence only, and with one outside."""
    third, text = F.col("doc_id") % 3, F.col("text")
    note = F.when(third == 0, F.concat(F.lit("---\ntags: "), "lang", F.lit("\n---\n"), text)).when(third == 1, F.concat(F.lit("```\na #tag\n```\n"), text)).otherwise(F.concat(text, F.lit("\nsee #"), "lang"))
    return model.table(spark, sf_dir, "documents").select("doc_id", files.eligible_note(note).alias("eligible"))


@query(r"""SELECT conv_id, turn + 2 AS line, 'dreams of ' || conv_id AS section, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, round(0.5 + (turn % 5) / 10.0, 6) + 0.0 AS score, turn AS recall_count, turn + 1 AS unique_queries
    FROM conversations WHERE turn % 4 <> 3 AND trim(text) <> ''""")
def s8_diaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as diaries, a turn a bullet below a heading; every fourth has no score and is no entry."""
    c = model.table(spark, sf_dir, "conversations")
    counts = F.when(F.col("turn") % 4 != 3, F.concat(F.lit(" {score="), F.format_string("%.1f", 0.5 + (F.col("turn") % 5) / 10.0), F.lit(", recall="), F.col("turn").cast("string"), F.lit(" uniquequeries="), (F.col("turn") + 1).cast("string"), F.lit("}"))).otherwise("")
    bullet = F.concat(F.lit("- "), F.trim(F.regexp_replace("text", r"\s+", " ")), counts)
    lines = c.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", bullet.alias("b")))), lambda x: x["b"]).alias("l"))
    notes = lines.select(F.col("conv_id").cast("string").alias("source_doc"), F.concat(F.lit("## Dreams of "), F.col("conv_id").cast("string"), F.lit("\n"), F.array_join("l", "\n")).alias("text"))
    out = files.diary(notes)
    return out.select(F.col("source_doc").cast("long").alias("conv_id"), F.col("line").cast("long").alias("line"), "section", "text", r6("score").alias("score"), F.col("recall_count").cast("long").alias("recall_count"), F.col("unique_queries").cast("long").alias("unique_queries"))


@query("""SELECT 'q' || conv_id AS question_id, 'kind ' || conv_id % 3 AS question_type, arg_min(text, turn) AS question, count(*) AS said FROM conversations GROUP BY conv_id""")
def s9_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as JSON documents, one array or an object around one a file, and read as benchmark instances."""
    c = model.table(spark, sf_dir, "conversations")
    said = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    rows = c.groupBy("conv_id").agg(F.array(said).alias("haystack_sessions"), F.min_by("text", "turn").alias("question"))
    item = F.struct(F.concat(F.lit("q"), F.col("conv_id").cast("string")).alias("question_id"), F.concat(F.lit("kind "), (F.col("conv_id") % 3).cast("string")).alias("question_type"), "question", "haystack_sessions")
    listed = rows.groupBy(F.floor(F.col("conv_id") / 10).alias("f")).agg(F.collect_list(item).alias("items"))  # ten to a file
    name = F.element_at(F.array(*map(F.lit, ("data", "instances", "questions", "items"))), (F.col("f") % 4 + 1).cast("int"))
    value = F.when(F.col("f") % 2 == 0, F.to_json("items")).otherwise(F.concat(F.lit('{"'), name, F.lit('":'), F.to_json("items"), F.lit("}")))
    folder = f"{_folder(spark)}/instances-{uuid.uuid4().hex}"
    listed.select(value.alias("value")).repartition(max(1, listed.count())).write.option("maxRecordsPerFile", 1).text(folder)
    return files.instances(spark, folder).select("question_id", "question_type", "question", F.size(F.col("haystack_sessions")[0]).cast("long").alias("said"))


@query("""SELECT event_id, user_id, event_type, round(value, 6) + 0.0 AS value FROM events""")
def s10_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{_folder(spark)}/lines-{uuid.uuid4().hex}"
    model.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value").write.json(folder)
    return files.json_lines(spark, folder, "event_id long, user_id long, event_type string, value double").withColumn("value", r6("value"))


@query("""SELECT vec_id AS id, len(embedding) AS size FROM embeddings""")
def k3_checked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors, each of the collection's dimension; one of another would fail the job."""
    return store.checked(model.vectors(spark, sf_dir), 64).select("id", F.size("vector").cast("long").alias("size"))


@query(rf"""WITH {turns_sql()}, w AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS w FROM turns),
    h AS (SELECT id, i, sum(('0x' || substr(sha256(w), 2 * i + 1, 2))::INT / 127.5 - 1.0) AS x FROM w CROSS JOIN (SELECT unnest(range(8)) AS i) GROUP BY ALL), v AS (SELECT t.id, session_id, list(x ORDER BY i) AS v FROM h JOIN turns t ON t.id = h.id GROUP BY ALL),
    s AS (SELECT q.id AS query_id, v.id, 'session_raw:' || v.session_id AS collection, list_cosine_similarity(q.v, v.v) AS score FROM v q JOIN v ON q.session_id = v.session_id AND q.id <> v.id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s) SELECT query_id, rank, id, collection, round(score, 6) + 0.0 AS score FROM r WHERE rank <= 3""")
def r7_raw_session_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every turn the three nearest others in the raw history of its own session."""
    t = model.turns(spark, sf_dir).withColumn("vector", V.hashed_embedding(F.col("text"), 8))
    raw = store.dual_write(t).where("raw_history")
    found = retrieve.top_k(raw, t.select(F.col("id").alias("query_id"), "vector", "session_id"), 3, within="session_id")
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "id", "collection", r6("score").alias("score"))


@query(rf"""WITH {turns_sql()} SELECT id, CASE ts_ms // 60000 % 5 WHEN 0 THEN text WHEN 1 THEN text || chr(10) || '[code block left out]' WHEN 2 THEN text || chr(10) || '[encoded data left out]' WHEN 3 THEN text || chr(10) || chr(10) || 'end' ELSE text || chr(10) || '```' || chr(10) || 'x' || chr(10) || '```' END AS clean FROM turns""")
def x9_sanitised_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with a large code block, an encoded line, blank lines, and a small block behind their text."""
    n = F.floor(F.col("ts_ms") / 60000) % 5
    more = F.when(n == 1, F.lit("\n```py\n" + "line\n" * 60 + "```")).when(n == 2, F.lit("\ndata:image/png;base64," + "QUJD" * 30)).when(n == 3, F.lit("\n\n  \n\nend")).when(n == 4, F.lit("\n```\nx\n```")).otherwise("")
    return model.turns(spark, sf_dir).select("id", protect.sanitised(F.concat("text", more)).alias("clean"))
