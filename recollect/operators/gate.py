"""The admission gate: how much a text is worth keeping, from novelty, repetition and what kinds of statements it makes.

Word borders and white space are those of ASCII. Texts are trimmed first; null counts as empty, and an empty text has no signals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import retrieve

# The words and phrases of each family, and the weights of the families.
DEFINERS = ["func", "def", "class"]
COMMANDS = ["git", "npm", "pnpm", "yarn", "go", "docker", "make", "kubectl"]
TITLES = ["mr", "mrs", "ms", "dr", "prof"]
RELATIONS = ["manager", "teammate", "friend", "colleague"]
PREFERENCES = ["i prefer", "i like", "i love", "my favorite", "i enjoy"]
FACTS = ["i work at", "i live in", "i am", "i have"]
DECISIONS = ["switched to", "migrated to", "replaced with", "decided to", "standardize on"]
RESOLUTIONS = ["fixed", "resolved", "patched", "corrected", "unblocked"]
MILESTONES = ["deployed", "merged", "released", "shipped", "rolled out"]
CONFIGURED = ["configured", "configuration changed", "env var", "environment var"]
STRUCTURES = ["struct", "interface", "type", "enum"]
DEPENDENCIES = ["import", "require", "go.mod", "package.json", "dependency", "depends on"]
BRANCHES = ["HEAD", "main", "master"]
TECHNICAL_WEIGHTS = {"fence": 0.5, "path": 0.4, "function": 0.4, "shell": 0.4, "url": 0.3, "trace": 0.5, "hash": 0.3}
PERSONAL_WEIGHTS = {"date": 0.3, "quantity": 0.2, "name": 0.3, "preference": 0.4, "fact": 0.3}
DENSITY_WEIGHTS = {"path": 0.4, "call": 0.3, "error": 0.5, "ref": 0.4, "url": 0.3}
ACTION_WEIGHTS = {"decision": 0.5, "resolution": 0.4, "milestone": 0.3, "configuration": 0.4}
DESIGN_WEIGHTS = {"function": 0.4, "structure": 0.3, "dependency": 0.3, "test": 0.2, "comment": 0.2}

SPACE = r"[\t\n\f\r ]"
_START, _END = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"


def _words(text: Column, words: list[str], *more: tuple[str, str]) -> Column:
    """Whether any of the words or phrases stands in the text as such; ``more``: further (text that must occur, pattern) pairs.

    Most texts lack them all, which plain searches tell; only those that have one are matched with borders.
    """
    literal = {w: w.replace(".", r"\.").replace("[", r"\[").replace("(", r"\(") for w in words}
    tests = [F.contains(text, F.lit(w)) & text.rlike(_START + p + _END) for w, p in literal.items()]
    tests += [F.contains(text, F.lit(w)) & text.rlike(p) for w, p in more]
    return reduce(lambda a, b: a | b, tests)


def _weighed(parts: dict[str, Column], weights: dict[str, float], scale: float = 1.0) -> Column:
    total = reduce(lambda a, b: a + b, [F.when(parts[k], w).otherwise(0.0) for k, w in weights.items()])
    return F.least(total / scale, F.lit(1.0))


def _kinds(text: Column, low: Column) -> dict[str, Column]:
    """Whether the text has each kind of statement; ``low`` is the text in lower case."""
    slash, paren, digit = (F.contains(text, F.lit(x)) for x in ("/", "(", "-"))
    opened = rf"{_START}[A-Za-z_][0-9A-Za-z_]*+{SPACE}*+\("
    return {
        "fence": F.contains(text, F.lit("```")) & text.rlike("(?s)```.+?```"),
        "path": slash & text.rlike(r"[\w.-]/[\w.-]"),
        "function": _words(text, DEFINERS) | (paren & text.rlike(opened)),
        "shell": _words(text, COMMANDS) | (F.contains(text, F.lit("$")) & text.rlike(rf"(?:\A|\n){SPACE}*+\$")),
        "url": slash & text.rlike(r"/[A-Za-z0-9._~/-]"),
        "trace": _words(low, ["stack trace", "traceback"], ("panic:", rf"{_START}panic:(?=[0-9a-z_])"), ("exception:", rf"{_START}exception:(?=[0-9a-z_])"), ("goroutine ", rf"{_START}goroutine \d++{_END}"), ("at ", rf"{_START}at [^:\t\n\f\r ]++:\d++{_END}")),
        "hash": text.rlike(rf"{_START}(?:[a-f0-9]{{7,40}}+|0x[a-fA-F0-9]++){_END}"),
        "date": (digit | slash) & text.rlike(rf"{_START}(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}/\d{{1,2}}/\d{{2,4}}){_END}"),
        "quantity": text.rlike(rf"{_START}\d++{_END}"),
        "name": low.rlike(rf"{_START}(?:(?:{'|'.join(TITLES)})\.?|my (?:{'|'.join(RELATIONS)})){SPACE}+[a-z]{{2,}}+{_END}"),
        "preference": _words(low, PREFERENCES),
        "fact": _words(low, FACTS, ("my ", rf"{_START}my [a-z]++ is{_END}")),
        "decision": _words(low, DECISIONS, (" instead", rf"{_START}use [^\n]+ instead{_END}")),
        "resolution": _words(low, RESOLUTIONS),
        "milestone": _words(low, MILESTONES),
        "configuration": _words(low, CONFIGURED, ("set ", rf"{_START}set [0-9a-z_]++ to{_END}")),
        "structure": _words(low, STRUCTURES, ("map[", rf"{_START}map\[(?=[0-9a-z_])")),
        "dependency": _words(low, DEPENDENCIES),
        "test": _words(low, [], ("func test", rf"{_START}func test[0-9a-z_]"), ("(", rf"{_START}(?:it|describe|test)\((?=[0-9a-z_])")),
        "comment": slash & text.rlike(rf"(?:\A|\n){SPACE}*+//|/\*\*|///"),
    }


def _counts(text: Column) -> dict[str, Column]:
    """How often the text refers to files, calls, errors, revisions and addresses. Matches don't overlap."""
    count = lambda guard, p: F.when(reduce(lambda a, b: a | b, [F.contains(text, F.lit(g)) for g in guard]), F.regexp_count(text, F.lit(p))).otherwise(0)
    return {
        "path": count("/", r"(?<![\w.-])[\w.-]++(?:/[\w.-]++)++"),
        "call": count("(", rf"{_START}[A-Za-z_][0-9A-Za-z_]*+{SPACE}*+\("),
        # By the letter: every word of three characters or more that begins with e counts, in either case.
        "error": F.regexp_count(text, F.lit(rf"{_START}(?:[eE][0-9A-Za-z_]{{2,}}+|[hH][tT][tT][pP]{SPACE}++[45]\d{{2}}{_END}|[45]\d{{2}}{_END})")),
        "ref": F.regexp_count(text, F.lit(rf"{_START}(?:(?:[a-f0-9]{{7,40}}+|{'|'.join(BRANCHES)}){_END}|origin/[A-Za-z0-9._/-]+{T.ASCII_BORDER})")),
        "url": count("/", r"https?://[^\t\n\f\r ]++|/[A-Za-z0-9._~/-]++"),
    }


def signals(turns: DataFrame) -> DataFrame:
    """Turns with the text's own signals: t (technical), d (personal detail), p (density), a (action), dtech (design)."""
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"(?U)^\s+|\s+$", "")
    rows = turns.withColumn("_text", text).withColumn("_low", F.lower("_text"))
    text, low = F.col("_text"), F.col("_low")
    rows = rows.withColumn("_is", F.struct(*[c.alias(k) for k, c in _kinds(text, low).items()]))
    parts = {k: F.col("_is")[k] for k in _kinds(text, low)}
    counted = reduce(lambda a, b: a + b, [c * DENSITY_WEIGHTS[k] for k, c in _counts(text).items()])
    size = F.greatest(T.tokens_floor(text) / 100.0, F.lit(1.0))
    out = rows.withColumns(
        {"t": _weighed(parts, TECHNICAL_WEIGHTS, 1.5), "d": _weighed(parts, PERSONAL_WEIGHTS), "p": F.least(counted / size, F.lit(1.0)), "a": _weighed(parts, ACTION_WEIGHTS), "dtech": _weighed(parts, DESIGN_WEIGHTS)}
    )
    return out.drop("_text", "_low", "_is")


def from_hits(hits: DataFrame) -> DataFrame:
    """(turn id, h, r) from search hits: (id, kind 'turn' or 'memory', rank, score). h is novelty, r repetition not yet remembered."""
    turn, memory = F.col("kind") == "turn", F.col("kind") == "memory"
    agg = hits.groupBy("id").agg(
        F.avg(F.when(memory & (F.col("rank") <= 5), F.greatest("score", F.lit(0.0)))).alias("m"),
        F.count_if(turn & (F.col("rank") <= 10) & (F.col("score") >= 0.8)).alias("n"),
        F.count_if(memory & (F.col("rank") <= 5) & (F.col("score") >= 0.85)).alias("s"),
    )
    r = F.least(F.col("n") / 5.0, F.lit(1.0)) * (1 - F.least(F.col("s") / 3.0, F.lit(1.0)))
    return agg.select("id", (1 - F.coalesce("m", F.lit(0.0))).alias("h"), r.alias("r"))


def hits_as_of(turns: DataFrame, index: DataFrame, memories: DataFrame) -> DataFrame:
    """Search hits of each turn as of its time: its 10 nearest in its user's turn index, itself and its own time included, and its 5 nearest among
    the user's memories from before it; rows (id, kind, rank, score) for ``from_hits``.

    All three have id, vector, user_ns and ts_ms; ids are those of one user at least. Users meet nobody else's rows: the search goes by tiles within each user, and
    no more than k rows a turn and tile are shuffled.
    """
    asked = turns.select(F.struct("user_ns", "id").alias("query_id"), "vector", "user_ns", "ts_ms")
    found = None
    for kind, rows, k, order in (("turn", index, 10, "<="), ("memory", memories, 5, "<")):
        # A turn is in the index before it is asked about, so it finds itself.
        near = retrieve.top_k(rows.withColumn("collection", F.lit(kind)), asked, k, exclude_self=False, within="user_ns", as_of=("ts_ms", order))
        part = near.select(F.col("query_id.user_ns").alias("user_ns"), F.col("query_id.id").alias("id"), F.lit(kind).alias("kind"), "rank", "score")
        found = part if found is None else found.unionByName(part)
    return found


def scored_as_of(turns: DataFrame, index: DataFrame, memories: DataFrame) -> DataFrame:
    """Turns (id, text, vector, user_ns, ts_ms, ...) with all signals, h and r as of each turn, g and passes."""
    hits = from_hits(hits_as_of(turns, index, memories).withColumn("id", F.struct("user_ns", "id")))
    rows = signals(turns).join(hits.select(F.col("id.user_ns").alias("user_ns"), F.col("id.id").alias("id"), "h", "r"), ["user_ns", "id"], "left")
    return gated(rows.withColumn("h", F.coalesce("h", F.lit(1.0))).withColumn("r", F.coalesce("r", F.lit(0.0))))


def gated(turns: DataFrame, threshold: float = 0.35) -> DataFrame:
    """Turns (with h and r, and the text's own signals) with g = (1 - t) * gconv + t * gtech, and whether it passes."""
    gconv = 0.35 * F.col("h") + 0.4 * F.col("r") + 0.25 * F.col("d")
    gtech = 0.4 * F.col("p") + 0.35 * F.col("a") + 0.25 * F.col("dtech")
    out = turns.withColumn("gconv", gconv).withColumn("gtech", gtech)
    return out.withColumn("g", T.clamp((1 - F.col("t")) * F.col("gconv") + F.col("t") * F.col("gtech"))).withColumn("passes", F.round("g", 9) >= threshold)
