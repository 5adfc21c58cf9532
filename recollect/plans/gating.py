"""The admission gate over turns and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions import vector as V
from ..operators import gate
from .common import r6, registry, turns_sql

QUERIES, ORACLE_SQL, query = registry()


# Words and phrases of each kind of statement, and weights.
WORDS = {
    "function": "func def class",
    "shell": "git npm pnpm yarn go docker make kubectl",
    "trace": "stack_trace traceback",
    "preference": "i_prefer i_like i_love my_favorite i_enjoy",
    "fact": "i_work_at i_live_in i_am i_have",
    "decision": "switched_to migrated_to replaced_with decided_to standardize_on",
    "resolution": "fixed resolved patched corrected unblocked",
    "milestone": "deployed merged released shipped rolled_out",
    "configuration": "configured configuration_changed env_var environment_var",
    "structure": "struct interface type enum",
    "dependency": "import require go.mod package.json dependency depends_on",
}
TITLES, RELATIONS = ["mr", "mrs", "ms", "dr", "prof"], ["manager", "teammate", "friend", "colleague"]
WEIGHTS = {
    "t": (1.5, {"fence": 0.5, "path": 0.4, "function": 0.4, "shell": 0.4, "url": 0.3, "trace": 0.5, "hash": 0.3}),
    "d": (1.0, {"date": 0.3, "quantity": 0.2, "name": 0.3, "preference": 0.4, "fact": 0.3}),
    "a": (1.0, {"decision": 0.5, "resolution": 0.4, "milestone": 0.3, "configuration": 0.4}),
    "dtech": (1.0, {"function": 0.4, "structure": 0.3, "dependency": 0.3, "test": 0.2, "comment": 0.2}),
}

# The SQL works on the list of a text's words (``w``, case kept) and on few small patterns with these borders; ``low`` is the text in lower case.
BEGIN, END, LATER = "(^|[^0-9A-Za-z_])", "($|[^0-9A-Za-z_])", "[0-9A-Za-z_]"
SPOT, INSTEAD = r"at [^: \t\n\f\r]+:[0-9]+", r"use [^\n]+ instead"


def _has(pattern: str, text: str = "low") -> str:
    return f"regexp_matches({text}, $${pattern}$$)"


def _says(kind: str, text: str = "low") -> str:
    return " OR ".join(_has(BEGIN + w.replace(".", "[.]").replace("_", " ") + END, text) for w in WORDS[kind].split())


def _word(pattern: str) -> str:
    """How many words are of this form."""
    return f"len(list_filter(w, lambda x: regexp_full_match(x, '{pattern}')))"


KINDS = {
    "fence": "strpos(text, '```') > 0 AND strpos(substr(text, strpos(text, '```') + 4), '```') > 0",
    "path": _has("[0-9A-Za-z_.-]/[0-9A-Za-z_.-]"),
    "function": f"{_says('function', 'text')} OR calls > 0",
    "shell": f"{_says('shell', 'text')} OR len(list_filter(string_split(text, chr(10)), lambda x: starts_with(ltrim(x, E' \\t\\f\\r'), '$'))) > 0",
    "url": _has("/[A-Za-z0-9._~/-]"),
    "trace": f"{_says('trace')} OR {' OR '.join(_has(BEGIN + x) for x in ('panic:' + LATER, 'exception:' + LATER, 'goroutine [0-9]+' + END, SPOT + END))}",
    "hash": f"{_word('[a-f0-9]{7,40}|0x[a-fA-F0-9]+')} > 0",
    "date": f"{_has(BEGIN + '[0-9]{4}(-[0-9]{2}){2}' + END)} OR {_has(BEGIN + '([0-9]{1,2}/){2}[0-9]{2,4}' + END)}",
    "quantity": f"{_word('[0-9]+')} > 0",
    "name": " OR ".join([*(_has(f"{BEGIN}{x}[.]?[ \\t\\n\\f\\r]+[a-z]{{2,}}{END}") for x in TITLES), *(_has(f"{BEGIN}my {x}[ \\t\\n\\f\\r]+[a-z]{{2,}}{END}") for x in RELATIONS)]),
    "preference": _says("preference"),
    "fact": f"{_says('fact')} OR {_has(BEGIN + 'my [a-z]+ is' + END)}",
    "decision": f"{_says('decision')} OR {_has(BEGIN + INSTEAD + END)}",
    "resolution": _says("resolution"),
    "milestone": _says("milestone"),
    "configuration": f"{_says('configuration')} OR {_has(BEGIN + 'set [0-9a-z_]+ to' + END)}",
    "structure": f"{_says('structure')} OR {_has(BEGIN + 'map[[]' + LATER)}",
    "dependency": _says("dependency"),
    "test": f"{_has(BEGIN + 'func test' + LATER)} OR {' OR '.join(_has(BEGIN + x + '[(]' + LATER) for x in ('it', 'describe', 'test'))}",
    "comment": "contains(text, '/**') OR contains(text, '///') OR len(list_filter(string_split(text, chr(10)), lambda x: starts_with(ltrim(x, E' \\t\\f\\r'), '//'))) > 0",
}
# What is counted: files (runs of names with slashes between them), calls (a name before a bracket), words that begin with e or are of the
# four and five hundreds, revisions (names after "origin/" whole), addresses and endpoints.
FILES = "len(list_filter(regexp_split_to_array(text, '[^0-9A-Za-z_./-]+|//+'), lambda x: contains(trim(x, '/'), '/')))"
CALLS = "len(list_filter(string_split(text, '(')[:-2], lambda x: regexp_matches(regexp_extract(rtrim(x, E' \\t\\n\\f\\r'), '[0-9A-Za-z_]*$'), '^[A-Za-z_]')))"
ORIGIN = f"regexp_replace(text, '{BEGIN}origin/[A-Za-z0-9._/-]*[0-9A-Za-z_]', '\\1' || chr(1), 'g')"
REFS = f"(length({ORIGIN}) - length(replace({ORIGIN}, chr(1), '')) + len(list_filter(regexp_split_to_array({ORIGIN}, '[^0-9A-Za-z_]+'), lambda x: regexp_full_match(x, '[a-f0-9]{{7,40}}') OR x IN ('HEAD', 'main', 'master'))))"
LINKS = "len(regexp_extract_all(text, '" + "|".join(["https?:" + "//[^ \\t\\n\\f\\r]+", "/[A-Za-z0-9._~/-]+"]) + "'))"


def _weighed(name: str) -> str:
    scale, weights = WEIGHTS[name]
    return f"least(({' + '.join(f'CASE WHEN {KINDS[k]} THEN {w} ELSE 0 END' for k, w in weights.items())})::DOUBLE / {scale}, 1.0) AS {name}"


def signals_sql(rows: str, keep: str) -> str:
    """Signals of the texts of a relation with a column ``text``, beside the columns ``keep``."""
    trimmed = rf"SELECT {keep}, regexp_replace(coalesce(text, ''), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS text FROM {rows}"
    split = f"SELECT *, lower(text) AS low, regexp_split_to_array(text, '[^0-9A-Za-z_]+') AS w, {CALLS} AS calls FROM ({trimmed})"
    counted = f"({FILES} * 0.4 + calls * 0.3 + ({_word('[eE][0-9A-Za-z_]{2,}|[45][0-9]{2}')}) * 0.5 + {REFS} * 0.4 + {LINKS} * 0.3)::DOUBLE"
    return f"SELECT {keep}, {', '.join(_weighed(k) for k in WEIGHTS)}, least({counted} / greatest(greatest(length(text) // 4, 1) / 100.0, 1.0), 1.0) AS p FROM ({split})"


#: Rows that the invented prose lacks: each family at least once.
SAMPLES = [
    "Deployed to prod: git push origin/main, see https://example.org/x and src/app/main.go",
    "I prefer tea. My manager Ann said it is 2024-05-06 and I live in Rome.",
    "```\ndef run(x):\n    return x\n```\nfixed the HTTP 503 with ERR_TIMEOUT at a.b:10",
    "set limit to 10, configured; decided to use struct Foo and import bar",
    "panic:oops goroutine 17 0xdeadbeef traceback",
    "we use git in this class", "edit src/app please", "GET /health now", "use maps or sets instead", "map[string]int and it(works)", "  $ ls\n\n  // see origin/x. and origin/-_", "each end e ERR_X HTTP  503 404 40 main HEAD deadbeef1 deadbee_",
    "a.b.c(1) f (2) 9x(3) //a/b ///c/d x//y", "mr. smith, MY FRIEND bo, my friend_x mrs x", "3.5x 4 1/2/345 1/2/3456 12-34", "at a:10x at b:12 exception: x exception:x PANIC:y", "environment var, set x to 5, env variable", " \n\u00a0 trimmed (a) \u00a0",
    "func TestThing() { describe(x) }\n// note\nnpm install\n$ ls",
    "",
]


@query(f"""WITH s AS (SELECT unnest(range({len(SAMPLES)})) AS id, unnest([{', '.join("'" + s.replace("'", "''") + "'" for s in SAMPLES)}]) AS text),
    x AS (SELECT 'sample' AS kind, id, text FROM s UNION ALL SELECT 'turn', conv_id * 1000 + turn, text FROM conversations UNION ALL SELECT 'page', page_id, html FROM pages)
    SELECT kind, id, round(t, 6) + 0.0 AS t, round(d, 6) + 0.0 AS d, round(p, 6) + 0.0 AS p, round(a, 6) + 0.0 AS a, round(dtech, 6) + 0.0 AS dtech FROM ({signals_sql('x', 'kind, id')})""")
def g4_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = spark.createDataFrame([("sample", i, s) for i, s in enumerate(SAMPLES)], "kind string, id long, text string")
    turns = model.table(spark, sf_dir, "conversations").select(F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    pages = model.table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    return gate.signals(samples.unionByName(turns).unionByName(pages)).select("kind", "id", *[r6(c).alias(c) for c in ("t", "d", "p", "a", "dtech")])


@query("""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vector, vec_id % 2 AS m FROM embeddings),
    s AS (SELECT q.id, v.id AS other, CASE WHEN v.m = 1 THEN 'memory' ELSE 'turn' END AS kind, list_cosine_similarity(q.vector, v.vector) AS score FROM v q JOIN v ON q.id % 20 = 0 AND q.id <> v.id),
    r AS (SELECT *, row_number() OVER (PARTITION BY id, kind ORDER BY round(score, 9) DESC, other) AS rank FROM s),
    g AS (SELECT id, avg(greatest(score, 0)) FILTER (kind = 'memory' AND rank <= 5) AS m, count(*) FILTER (kind = 'turn' AND rank <= 10 AND score >= 0.8) AS n, count(*) FILTER (kind = 'memory' AND rank <= 5 AND score >= 0.85) AS s FROM r GROUP BY id),
    x AS (SELECT id, 1 - coalesce(m, 0) AS h, least(n / 5.0, 1.0) * (1 - least(s / 3.0, 1.0)) AS r, (id % 10) / 10.0 AS t, (id % 7) / 7.0 AS d, (id % 3) / 3.0 AS p, (id % 4) / 4.0 AS a, (id % 5) / 5.0 AS dtech FROM g),
    c AS (SELECT *, 0.35 * h + 0.4 * r + 0.25 * d AS gconv, 0.4 * p + 0.35 * a + 0.25 * dtech AS gtech FROM x)
    SELECT id, round(h, 6) + 0.0 AS h, round(r, 6) + 0.0 AS r, round(least(greatest((1 - t) * gconv + t * gtech, 0), 1), 6) + 0.0 AS g, round(least(greatest((1 - t) * gconv + t * gtech, 0), 1), 9) >= 0.35 AS passes FROM c""")
def g1_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import retrieve

    v = model.vectors(spark, sf_dir).withColumn("collection", F.when(F.col("id") % 2 == 1, "memory").otherwise("turn"))
    hits = retrieve.top_k(v, v.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector"), 10, per_collection=True)
    found = gate.from_hits(hits.select(F.col("query_id").alias("id"), F.col("collection").alias("kind"), "rank", "score"))
    share = lambda n: (F.col("id") % n) / float(n)
    out = gate.gated(found.withColumns({"t": share(10), "d": share(7), "p": share(3), "a": share(4), "dtech": share(5)}))
    return out.select("id", r6("h").alias("h"), r6("r").alias("r"), r6("g").alias("g"), "passes")


@query(rf"""WITH {turns_sql()}, u AS (SELECT * FROM turns WHERE role = 'user'),
    w AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS w FROM u),
    h AS (SELECT id, i, sum(('0x' || substr(sha256(w), 2 * i + 1, 2))::INT / 127.5 - 1.0) AS x FROM w CROSS JOIN (SELECT unnest(range(8)) AS i) GROUP BY id, i),
    v AS (SELECT u.id, u.user_ns, u.ts_ms, list(x ORDER BY i) AS v FROM h JOIN u ON u.id = h.id GROUP BY ALL),
    p AS (SELECT a.id, b.id AS other, b.ts_ms < a.ts_ms AS earlier, list_cosine_similarity(a.v, b.v) AS score FROM v a JOIN v b ON a.user_ns = b.user_ns AND b.ts_ms <= a.ts_ms),
    t AS (SELECT id, count(*) FILTER (score >= 0.8) AS n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, other) AS rank FROM p) WHERE rank <= 10 GROUP BY id),
    m AS (SELECT id, avg(greatest(score, 0)) AS m, count(*) FILTER (score >= 0.85) AS s FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, other) AS rank FROM p WHERE earlier) WHERE rank <= 5 GROUP BY id),
    x AS (SELECT t.id, 1 - coalesce(m, 0) AS h, least(n / 5.0, 1.0) * (1 - least(coalesce(s, 0) / 3.0, 1.0)) AS r FROM t LEFT JOIN m ON m.id = t.id),
    c AS (SELECT x.id, h, r, g.t, 0.35 * h + 0.4 * r + 0.25 * d AS gconv, 0.4 * p + 0.35 * a + 0.25 * dtech AS gtech FROM x JOIN ({signals_sql('u', 'id')}) g ON g.id = x.id),
    y AS (SELECT id, h, r, least(greatest((1 - t) * gconv + t * gtech, 0), 1) AS g FROM c)
    SELECT id, round(h, 6) + 0.0 AS h, round(r, 6) + 0.0 AS r, round(g, 6) + 0.0 AS g, round(g, 9) >= 0.35 AS passes FROM y""")
def g9_gate_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' turns as they came in: each is gated after it was put into the turn index, against the memories made of those before it."""
    said = model.turns(spark, sf_dir).where("role = 'user'").withColumn("vector", V.hashed_embedding(F.col("text"), 8))
    return gate.scored_as_of(said, said, said).select("id", r6("h").alias("h"), r6("r").alias("r"), r6("g").alias("g"), "passes")
