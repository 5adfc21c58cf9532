"""Ranking, recovery and packing over candidates made of vectors, labels and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions import text as T
from ..operators import pack, rank, retrieve
from .common import NOW_MS, VECTORS_SQL, r6, registry, turns_sql

QUERIES, ORACLE_SQL, query = registry()

SCOPES = ["session", "user", "global"]


def candidates(spark: SparkSession, sf_dir: str, k: int = 30) -> DataFrame:
    """k candidates of each query vector, with scope, time, type, access counts (from events) and authority (from labels)."""
    v = model.vectors(spark, sf_dir)
    found = retrieve.top_k(v, v.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector"), k)
    uses = model.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("access_count"))
    trust = model.table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg((F.max("quality") * 0.8).cast("double").alias("authority"))
    out = found.join(uses, "id", "left").join(trust, "id", "left")
    scope = F.element_at(F.array(*[F.lit(s) for s in SCOPES]), (F.col("id") % 3 + 1).cast("int"))
    return out.select(
        "query_id", "collection", "id", "score", "access_count", "authority", scope.alias("scope"),
        F.when(F.col("id") % 11 != 0, F.lit(NOW_MS) - F.col("id") * 60_000).alias("ts_ms"),
        F.when(F.col("id") % 4 == 0, "summary").otherwise("turn").alias("type"),
        ((F.col("id") % 10) / 10.0).alias("decay_rate"), ((F.col("id") % 9) / 9.0).alias("confidence"), (F.col("id") % 5 == 0).alias("authored"),
    )


CANDIDATES = f"""{VECTORS_SQL}, s AS (SELECT q.id AS query_id, v.id, v.collection, list_cosine_similarity(q.vector, v.vector) AS score FROM v q JOIN v ON q.id % 20 = 0 AND q.id <> v.id),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS pos FROM s),
    uses AS (SELECT user_id AS id, count(*) AS access_count FROM events GROUP BY 1),
    trust AS (SELECT doc_id AS id, max(quality) * 0.8::DOUBLE AS authority FROM labels GROUP BY 1),
    cand AS (SELECT k.query_id, k.collection, k.id, k.score, access_count, authority, ['session', 'user', 'global'][k.id % 3 + 1] AS scope,
      CASE WHEN k.id % 11 <> 0 THEN {NOW_MS} - k.id * 60000 END AS ts_ms, CASE WHEN k.id % 4 = 0 THEN 'summary' ELSE 'turn' END AS type,
      (k.id % 10) / 10.0::DOUBLE AS decay_rate, (k.id % 9) / 9.0::DOUBLE AS confidence, k.id % 5 = 0 AS authored
      FROM k LEFT JOIN uses USING (id) LEFT JOIN trust USING (id) WHERE pos <= 30)"""
AGE = f"greatest({NOW_MS} - coalesce(ts_ms, {NOW_MS}), 0) / 1000.0::DOUBLE"

HYBRID = f"""SELECT query_id, id, type, decay_rate, 0.7 * least(greatest(score, 0), 1) + 0.2 * exp(-(CASE scope WHEN 'session' THEN 1e-4 WHEN 'user' THEN 1e-5 ELSE 2e-6 END)::DOUBLE * {AGE})
    + 0.1 * CASE scope WHEN 'session' THEN 1.0 WHEN 'user' THEN 0.6 ELSE 0.3 END AS base FROM cand"""


@query(f"""WITH {CANDIDATES}, h AS ({HYBRID}) SELECT query_id, id, round(CASE WHEN type = 'summary' THEN base * (1 - 0.5 * decay_rate) ELSE base END, 6) + 0.0 AS final_score FROM h""")
def c1_hybrid_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.hybrid(candidates(spark, sf_dir), NOW_MS).select("query_id", "id", r6("final_score").alias("final_score"))


TWO_PASS = f"""one AS (SELECT *, greatest(least(score, 1), -1) AS sim, row_number() OVER (PARTITION BY query_id ORDER BY round(greatest(least(score, 1), -1), 9) DESC, collection, id) AS p FROM cand),
    few AS (SELECT *, max(coalesce(access_count, 0)) OVER (PARTITION BY query_id) AS most FROM one WHERE p <= 16 AND sim >= 0.2),
    o AS (SELECT *, least(greatest(0.5 * exp(-1e-5::DOUBLE * {AGE}) + 0.2 * CASE WHEN coalesce(access_count, 0) > 0 AND most > 0 THEN ln(1.0 + access_count) / ln(2.0 + most) ELSE 0 END
        + 0.3 * least(greatest(coalesce(authority, CASE WHEN authored THEN 1.0 ELSE 0.0 END), 0), 1), 0), 1) AS omega FROM few),
    f AS (SELECT *, least(greatest(omega * greatest(sim, 0) / 1.3, 0), 1) AS final_score FROM o),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(final_score, 9) DESC, collection, id) AS rank FROM f QUALIFY rank <= 8)"""


def _two_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.two_pass(candidates(spark, sf_dir), NOW_MS)


@query(f"""WITH {CANDIDATES}, {TWO_PASS} SELECT query_id, rank, id, round(omega, 6) + 0.0 AS omega, round(final_score, 6) + 0.0 AS final_score FROM ranked""")
def c2_two_pass_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two_pass(spark, sf_dir).select("query_id", F.col("rank").cast("long").alias("rank"), "id", r6("omega").alias("omega"), r6("final_score").alias("final_score"))


HOPS = """t AS (SELECT id, unnest([id + 1, id + 7, (id * 3) % 400]) AS target FROM v), tt AS (SELECT DISTINCT t.id, t.target FROM t JOIN v ON t.target = v.id),
    hop AS (SELECT r.query_id, tt.target AS id, max(0.5 * least(greatest(r.final_score, 0), 1)) AS final_score FROM ranked r JOIN tt ON r.id = tt.id
      WHERE NOT EXISTS (SELECT 1 FROM ranked x WHERE x.query_id = r.query_id AND x.id = tt.target) GROUP BY 1, 2 HAVING round(max(0.5 * least(greatest(r.final_score, 0), 1)), 9) >= 0.15)"""


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = model.vectors(spark, sf_dir).select("id")
    links = v.select("id", F.explode(F.array(F.col("id") + 1, F.col("id") + 7, (F.col("id") * 3) % 400)).alias("target")).distinct()
    return links.join(v.select(F.col("id").alias("target")), "target")


@query(f"""WITH {CANDIDATES}, {TWO_PASS}, {HOPS} SELECT query_id, id, round(final_score, 6) + 0.0 AS final_score FROM hop""")
def c4_hop_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.hops(_two_pass(spark, sf_dir), _targets(spark, sf_dir)).select("query_id", "id", r6("final_score").alias("final_score"))


@query(f"""WITH {CANDIDATES}, {TWO_PASS}, {HOPS} SELECT query_id, id, 0 AS hop, round(final_score, 6) + 0.0 AS final_score FROM ranked UNION ALL SELECT query_id, id, 1, round(final_score, 6) + 0.0 FROM hop""")
def c5_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _two_pass(spark, sf_dir)
    return rank.merged(ranked, rank.hops(ranked, _targets(spark, sf_dir))).select("query_id", "id", "hop", r6("final_score").alias("final_score"))


@query(f"""WITH {CANDIDATES}, {TWO_PASS}, d AS (SELECT query_id, bool_or(id % 6 = 0) AS deep, arg_min(final_score, rank) AS top, count(*) FILTER (rank <= 4) AS n,
      count(*) FILTER (rank <= 4 AND type = 'summary') AS s, avg(confidence) FILTER (rank <= 4) AS mean FROM ranked GROUP BY 1)
    SELECT query_id, (deep AND top < 0.15) OR (n >= 4 AND s = n AND mean < 0.5) AS fired, top < 0.15 AS low_top, n >= 4 AND s = n AND mean < 0.5 AS weak_summaries FROM d""")
def c6_failure_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _two_pass(spark, sf_dir).withColumn("cascade_tier", F.when(F.col("id") % 6 == 0, 3).otherwise(1))
    return rank.retrieval_failed(ranked)




#: Questions and texts about time, dealt over the conversations by conv_id, beside their own texts.
TIMES = [
    "How long after the move did we meet on 2024-01-05 at 10:30 today?",
    "When did it first happen, before or since May 12, 2023 or last week?",
    "How many weeks between Jan 5 and Sept 3rd, 2021, or how  many days?",
    "Tonight, this week, last night, midweek and mid-march at 9:15 pm, 12/5/2020, next Friday, last Friday, 1700000000, 1999",
]

# Words of questions about time with their weights (each row once), and words that anchor a text in time.
ASKS = [(["how many days"], 1.0), (["how long"], 0.9), (["before", "after"], 0.8), (["since", "between"], 0.7), (["first", "earlier"], 0.8), (["when did"], 0.7)]
MONTHS = "january february march april may june july august september october november december"
DAYS = "monday tuesday wednesday thursday friday saturday sunday"
NEAR_DAYS, LAST, NEXT = "today yesterday tomorrow", "week month year night saturday sunday", f"week month year {DAYS}"


def _either(words: str) -> str:
    return "(?:" + "|".join(words.split()) + ")"


def _word(pattern: str) -> str:
    return rf"\b{pattern}\b"


def anchor_patterns() -> list[str]:
    """Dates, times and numbers of years or seconds by their digits; month names may be cut to three letters (September to four)."""
    short = "|".join(f"{m[:3]}|{m}" for m in MONTHS.split() if len(m) > 3) + "|may|sept"
    day = r"[0-9]{1,2}"
    return [
        _word("-".join(f"[0-9]{{{n}}}" for n in (4, 2, 2))),
        _word(f"{day}/{day}(?:/[0-9]{{2,4}})?"),
        _word(rf"(?:{short})\s+{day}(?:{'|'.join(('st', 'nd', 'rd', 'th'))})?(?:,\s*[0-9]{{4}})?"),
        _word(_either(DAYS)),
        _word(f"(?:{_either(NEAR_DAYS)}|last\\s+{_either(LAST)}|next\\s+{_either(NEXT)}|mid-?[a-z]+)"),
        _word(rf"{day}:[0-9]{{2}}(?:\s?{_either('am pm')})?"),
        _word(f"{_either('19 20')}[0-9]{{2}}"),
        _word("[0-9]{10,13}"),
    ]


def _asked(words: list[str]) -> str:
    return " OR ".join(f"regexp_matches(t, '{_word(w.replace(' ', chr(92) + 's+'))}')" for w in words)


@query(rf"""WITH q AS (SELECT conv_id, turn, lower(CASE conv_id % 6 {' '.join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(TIMES))} ELSE text END) AS t FROM conversations)
    SELECT conv_id, turn, round(least(({' + '.join(f"CASE WHEN {_asked(ws)} THEN {w} ELSE 0 END" for ws, w in ASKS)})::DOUBLE / 1.5, 1.0), 6) + 0.0 AS indicator,
    round(least(len(list_distinct(flatten([{', '.join(f"regexp_extract_all(t, '{p}')" for p in anchor_patterns())}]))) / 3.0::DOUBLE, 1.0), 6) + 0.0 AS anchors FROM q""")
def c11_temporal_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.coalesce(F.get(F.array(*map(F.lit, TIMES)), (F.col("conv_id") % 6).cast("int")), F.col("text"))
    return model.table(spark, sf_dir, "conversations").select("conv_id", "turn", r6(rank.temporal_indicator(asked)).alias("indicator"), r6(rank.anchor_density(asked)).alias("anchors"))


TERMS = r"list_filter(regexp_split_to_array(lower({}), '[^a-z0-9_]+'), lambda x: x <> '')"
RECOVER = rf"""{turns_sql('conv_id % 10')},
    q AS (SELECT session_id AS query_session, list_distinct(list_filter({TERMS.format('text')}, lambda x: length(x) >= 3)) AS words, id AS query_id FROM turns WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts_ms, id) = 1),
    c AS (SELECT q.query_id, t.id, t.ts_ms, CASE WHEN len(words) > 0 THEN len(list_intersect(words, {TERMS.format('t.text')}))::DOUBLE / len(words) ELSE 0 END AS lexical FROM q JOIN turns t ON t.session_id = q.query_session AND t.id <> q.query_id)"""


@query(f"""WITH {RECOVER} SELECT query_id, id, round(lexical, 6) + 0.0 AS lexical, round(least(greatest(0.7 * lexical + 0.1 * exp(-1e-5::DOUBLE * greatest({NOW_MS} - ts_ms, 0) / 1000.0::DOUBLE), 0), 1), 6) + 0.0 AS final_score FROM c""")
def c8_raw_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import session

    t = model.turns(spark, sf_dir, 10)
    q = t.where("role = 'user'").withColumn("_r", F.row_number().over(session.ordered())).where("_r = 1").select("session_id", F.col("id").alias("query_id"), T.keywords(F.col("text")).alias("words"))
    c = t.join(q, "session_id").where("id <> query_id").withColumn("score", F.lit(0.0))
    return rank.raw_recovery(c, NOW_MS, F.col("words")).select("query_id", "id", r6("lexical").alias("lexical"), r6("final_score").alias("final_score"))


@query(r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: x <> '') AS t FROM documents)
    SELECT doc_id, round(len(list_filter([['the', 'than'], ['und', 'der', 'die'], ['que', 'les']], lambda s: 2 * len(list_intersect(s, t)) >= len(s))) / 3.0::DOUBLE, 6) + 0.0 AS covered FROM d""")
def c14_slot_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = F.array(*[F.array(*[F.lit(w) for w in s]) for s in (["the", "than"], ["und", "der", "die"], ["que", "les"])])
    return model.table(spark, sf_dir, "documents").select("doc_id", r6(rank.slot_coverage(slots, F.col("text"))).alias("covered"))


@query(f"""WITH {CANDIDATES}, x AS (SELECT query_id, id, least(greatest(score, 0), 1) AS sem, exp(-1e-5::DOUBLE * {AGE}) AS rec, (id % 4) / 3.0::DOUBLE AS anchor, (id % 3) / 2.0::DOUBLE AS covered, (id % 8) / 7.0::DOUBLE AS witness, query_id % 40 = 0 AS comparison, id % 2 = 0 AS active FROM cand)
    SELECT query_id, id, round(least(greatest(CASE WHEN comparison THEN 0.15 * sem + 0.15 * rec + 0.15 * covered + 0.55 * witness ELSE 0.4 * sem + 0.25 * rec + 0.2 * anchor + 0.15 * covered + CASE WHEN active THEN 0.05 ELSE 0 END END, 0), 1), 6) + 0.0 AS final_score FROM x""")
def c16_temporal_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).withColumns({"anchor": (F.col("id") % 4) / 3.0, "covered": (F.col("id") % 3) / 2.0, "witness": (F.col("id") % 8) / 7.0, "comparison": F.col("query_id") % 40 == 0, "active": F.col("id") % 2 == 0})
    return rank.temporal_recovery(c, NOW_MS).select("query_id", "id", r6("final_score").alias("final_score"))


@query(f"""WITH {CANDIDATES}, x AS (SELECT query_id, id, id % 2 AS side, ((id * 7) % 16) / 16.0::DOUBLE AS witness, round(score, 6) AS final_score, id % 90 + 10 AS tokens FROM cand),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id, side ORDER BY witness DESC, final_score DESC, tokens, id) AS pos FROM x),
    p AS (SELECT a.query_id, a.id AS first_id, b.id AS second_id, a.witness + b.witness AS witness, a.tokens + b.tokens AS tokens, a.pos AS pa, b.pos AS pb FROM o a JOIN o b ON a.query_id = b.query_id AND a.side = 0 AND b.side = 1 AND a.id <> b.id AND a.tokens + b.tokens <= 90)
    SELECT query_id, first_id, second_id, round(witness, 6) + 0.0 AS witness, tokens FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(witness, 9) DESC, tokens, pa, pb) = 1""")
def c20_best_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).select("query_id", "id", (F.col("id") % 2).alias("side"), (((F.col("id") * 7) % 16) / 16.0).alias("witness"), F.round("score", 6).alias("final_score"), (F.col("id") % 90 + 10).alias("tokens"), F.lit(90).alias("budget"))
    return rank.best_pairs(c).select("query_id", "first_id", "second_id", r6("witness").alias("witness"), "tokens")


ITEMS = f"WITH {CANDIDATES}, {TWO_PASS}, i AS (SELECT query_id, rank, id, id % 50 + 20 AS tokens FROM ranked)"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two_pass(spark, sf_dir).select("query_id", F.col("rank").cast("long").alias("rank"), "id", (F.col("id") % 50 + 20).alias("tokens"))


@query(ITEMS + """, u AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS used FROM i) SELECT query_id, rank, id, tokens, used FROM u WHERE used <= 160""")
def p1_prefix_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.prefix_fit(_items(spark, sf_dir), 160).select("query_id", "rank", "id", "tokens", "used")


@query(ITEMS.replace("WITH", "WITH RECURSIVE", 1) + """, g AS (SELECT query_id, 0::BIGINT AS rank, 0::BIGINT AS used, []::VARCHAR[] AS ids FROM (SELECT DISTINCT query_id FROM i)
    UNION ALL SELECT g.query_id, i.rank, CASE WHEN g.used + i.tokens <= 100 THEN g.used + i.tokens ELSE g.used END, CASE WHEN g.used + i.tokens <= 100 THEN list_append(g.ids, i.id::VARCHAR) ELSE g.ids END FROM g JOIN i ON i.query_id = g.query_id AND i.rank = g.rank + 1),
    l AS (SELECT query_id, arg_max(used, rank) AS used, arg_max(ids, rank) AS ids FROM g GROUP BY 1) SELECT query_id, used, generate_subscripts(ids, 1) - 1 AS position, unnest(ids) AS id FROM l""")
def p2_first_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.first_fit(_items(spark, sf_dir), 100).select("query_id", "used", F.col("position").cast("long").alias("position"), "id")


@query("""WITH q AS (SELECT vec_id AS query_id, (vec_id % 40) * 100.0::DOUBLE AS budget, (vec_id % 13) * 20.0::DOUBLE AS hard, (vec_id % 7) * 30.0::DOUBLE AS tail_base, vec_id % 3 = 0 AS fired, vec_id % 2 = 0 AS comparison FROM embeddings),
    m AS (SELECT *, 0.25 * budget AS memory FROM q), s AS (SELECT *, greatest(least(0.3 * memory, memory - hard - tail_base), 0) AS soft FROM m),
    r AS (SELECT *, greatest(memory - hard - tail_base - soft, 0) AS retrieval, least(greatest(least(floor(0.1 * memory), 128), 16), memory) AS b FROM s)
    SELECT query_id, hard + tail_base > memory AS degraded, round(soft, 6) + 0.0 AS soft, round(retrieval, 6) + 0.0 AS retrieval, round(least(0.15 * memory, retrieval), 6) + 0.0 AS elevated,
      round(CASE WHEN NOT fired THEN 0 WHEN comparison THEN ceil(1.8 * b) ELSE b END::DOUBLE, 6) + 0.0 AS reserve FROM r""")
def p5_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    q = model.table(spark, sf_dir, "embeddings").select(i.alias("query_id"), ((i % 40) * 100.0).alias("budget"), ((i % 13) * 20.0).alias("hard"), ((i % 7) * 30.0).alias("tail_base"), (i % 3 == 0).alias("fired"), (i % 2 == 0).alias("comparison"))
    return pack.budgets(q).select("query_id", "degraded", *[r6(c).alias(c) for c in ("soft", "retrieval", "elevated", "reserve")])


@query(f"""WITH {CANDIDATES}, x AS (SELECT query_id, collection, id // 5 AS id, round(score, 6) AS final_score FROM cand)
    SELECT query_id, collection, id, max(final_score) + 0.0 AS final_score FROM x GROUP BY 1, 2, 3""")
def p4_recovery_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).select("query_id", "collection", F.floor(F.col("id") / 5).alias("id"), F.round("score", 6).alias("final_score"))
    return pack.best_of_each(c).select("query_id", "collection", "id", r6("final_score").alias("final_score"))


PAIRS = ITEMS.replace("WITH", "WITH RECURSIVE", 1) + """, w AS (SELECT *, id % 3 = 0 AS witness FROM i), c AS (SELECT *, count(*) FILTER (witness) OVER (PARTITION BY query_id) = 2 AND coalesce(sum(tokens) FILTER (witness) OVER (PARTITION BY query_id) <= 120, false) AS pair FROM w),
    oo AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN pair AND witness THEN 0 ELSE 1 END, rank) AS ord FROM c),
    g AS (SELECT query_id, 0::BIGINT AS ord, 0::BIGINT AS used, []::VARCHAR[] AS ids FROM (SELECT DISTINCT query_id FROM oo)
      UNION ALL SELECT g.query_id, o.ord, CASE WHEN g.used + o.tokens <= 120 THEN g.used + o.tokens ELSE g.used END, CASE WHEN g.used + o.tokens <= 120 THEN list_append(g.ids, o.id::VARCHAR) ELSE g.ids END FROM g JOIN oo o ON o.query_id = g.query_id AND o.ord = g.ord + 1),
    l AS (SELECT query_id, arg_max(used, ord) AS used, arg_max(ids, ord) AS ids FROM g GROUP BY 1) SELECT query_id, used, generate_subscripts(ids, 1) - 1 AS position, unnest(ids) AS id FROM l"""


@query(PAIRS)
def p3_protected_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir).withColumn("witness", F.col("id") % 3 == 0)
    return pack.protected_pair_fit(items, 120).select("query_id", "used", F.col("position").cast("long").alias("position"), "id")


@query(ITEMS + """, sections AS (SELECT query_id, id, rank, ['hard', 'tail_base', 'soft', 'tail_extension', 'elevated', 'variant', 'recovery'][id % 7 + 1] AS section, id % 7 AS sec FROM i)
    SELECT query_id, id, section, row_number() OVER (PARTITION BY query_id ORDER BY sec, rank) AS position FROM sections""")
def p7_concatenation(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(s) for s in pack.SECTION_ORDER])
    items = _items(spark, sf_dir).withColumn("section", F.element_at(names, (F.col("id") % 7 + 1).cast("int")))
    return pack.concatenated(items).select("query_id", "id", "section", F.col("position").cast("long").alias("position"))


@query(ITEMS.replace("WITH", "WITH RECURSIVE", 1) + """, su AS (SELECT i.query_id, i.rank, i.id AS parent, i.id % 3 + 1 AS depth FROM i WHERE i.id % 3 < 2 AND (i.id % 10) / 10.0 >= 0.7),
    ch AS (SELECT su.*, n, parent * 10 + n AS id, (parent + n) % 9 / 8.0::DOUBLE AS score, CASE WHEN n <> 2 THEN (parent + 7 * n) % 40 + 0.5 END AS est FROM su CROSS JOIN (SELECT unnest(range(5)) AS n)),
    oc AS (SELECT *, greatest(floor(est), 1)::BIGINT AS tokens, row_number() OVER (PARTITION BY query_id ORDER BY rank, n, id) AS place FROM ch WHERE est > 0),
    gr AS (SELECT query_id, 0::BIGINT AS place, 0::BIGINT AS used, false AS took FROM (SELECT DISTINCT query_id FROM oc)
      UNION ALL SELECT gr.query_id, oc.place, CASE WHEN gr.used + tokens <= 60 THEN gr.used + tokens ELSE gr.used END, gr.used + tokens <= 60 FROM gr JOIN oc ON oc.query_id = gr.query_id AND oc.place = gr.place + 1),
    us AS (SELECT query_id, max(used) AS used FROM gr GROUP BY 1)
    SELECT oc.query_id, oc.parent, oc.id, round(least(greatest(score * 0.85, 0), 1), 6) + 0.0 AS final_score, oc.depth, us.used FROM oc JOIN gr ON gr.query_id = oc.query_id AND gr.place = oc.place AND took JOIN us ON us.query_id = oc.query_id""")
def c7_summary_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _items(spark, sf_dir).select("query_id", "rank", "id", F.when(F.col("id") % 3 < 2, "summary").otherwise("turn").alias("type"), ((F.col("id") % 10) / 10.0).alias("confidence"), (F.col("id") % 3).alias("expansion_depth"))
    k = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("child_order")
    children = model.vectors(spark, sf_dir).select(F.col("id").alias("parent"), k).select(
        "parent", "child_order", (F.col("parent") * 10 + F.col("child_order")).alias("id"), ((F.col("parent") + F.col("child_order")) % 9 / 8.0).alias("score"), F.when(F.col("child_order") != 2, (F.col("parent") + 7 * F.col("child_order")) % 40 + 0.5).alias("token_estimate")
    )
    out = rank.expanded_summaries(i, children, 60)
    return out.select("query_id", "parent", "id", r6("final_score").alias("final_score"), F.col("depth").cast("long").alias("depth"), "used")
