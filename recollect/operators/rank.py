"""Ranking laws over candidate rows, for many queries at once.

Candidates carry query_id, collection, id, score (cosine) and, where a law asks for them, ts_ms, type,
decay_rate, access_count, authority, authored, confidence, text and scope; a missing time counts as now.
Everything is column expressions and windows by query.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from . import pack


def by_query():
    return Window.partitionBy("query_id")


#: Decay per second and weight of each scope.
DECAY = {"session": 1e-4, "user": 1e-5, "global": 2e-6}
SCOPE_WEIGHT = {"session": 1.0, "user": 0.6, "global": 0.3}


def by_scope(scope: Column, values: dict[str, float]) -> Column:
    return F.when(scope == "session", values["session"]).when(scope == "user", values["user"]).otherwise(values["global"])


def recency(ts_ms: Column, now_ms: int, decay: Column | float) -> Column:
    age = F.greatest(F.lit(now_ms) - F.coalesce(ts_ms, F.lit(now_ms)), F.lit(0)) / 1000.0
    return F.exp(-decay * age if isinstance(decay, float) else -(decay * age))


def hybrid(candidates: DataFrame, now_ms: int, alpha: float = 0.7, beta: float = 0.2, gamma: float = 0.1, delta: float = 0.5) -> DataFrame:
    """final_score: similarity, recency and scope in shares, summaries marked down by their decay rate."""
    w = [min(max(x, 0.0), 1.0) for x in (alpha, beta, gamma)]
    w = [x / sum(w) for x in w] if sum(w) > 0 else [0.7, 0.2, 0.1]
    scope = F.col("scope")
    base = w[0] * T.clamp(F.col("score")) + w[1] * recency(F.col("ts_ms"), now_ms, by_scope(scope, DECAY)) + w[2] * by_scope(scope, SCOPE_WEIGHT)
    marked = F.when(F.col("type") == "summary", base * (1 - delta * T.clamp(F.coalesce(F.col("decay_rate"), F.lit(0.0))))).otherwise(base)
    return candidates.withColumn("final_score", marked)


def deduplicated(candidates: DataFrame, order: list[Column]) -> DataFrame:
    """The first candidate, by ``order``, of each (query, collection, id)."""
    w = Window.partitionBy("query_id", "collection", "id").orderBy(*order)
    return candidates.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first")


def two_pass(candidates: DataFrame, now_ms: int, words: Column | None = None, k1: int = 16, k2: int = 8, theta: float = 0.2, kappa: float = 0.3, weights: tuple[float, float, float] = (0.5, 0.2, 0.3), decay: float = 1e-5) -> DataFrame:
    """The two-pass rank: k1 by similarity, those at ``theta`` or more, then k2 by authority-weighted similarity.

    The largest access count is taken over the survivors of the first pass only. ``words``: share of the
    query's keywords in a candidate. Ties go by collection and id. Of candidates with one collection and id the first counts:
    by a column ``position``, if there is one, else by similarity.
    """
    sim = T.clamp(F.col("score"), -1.0, 1.0)
    order = [F.round("_sim", 9).desc(), F.col("collection"), F.col("id")]
    first_of = [F.col("position"), *order] if "position" in candidates.columns else order
    once = deduplicated(candidates.withColumn("_sim", sim), first_of)
    first = once.withColumn("_r", F.row_number().over(by_query().orderBy(*order))).where((F.col("_r") <= k1) & (F.col("_sim") >= theta))
    most = F.max(F.coalesce("access_count", F.lit(0))).over(by_query())
    count = F.coalesce(F.col("access_count"), F.lit(0))
    freq = F.when((count > 0) & (F.col("_most") > 0), F.log(1.0 + count) / F.log(2.0 + F.col("_most"))).otherwise(0.0)
    authority = T.clamp(F.coalesce(F.col("authority"), F.when(F.col("authored"), 1.0).otherwise(0.0)))
    total = sum(weights)
    omega = T.clamp((weights[0] * recency(F.col("ts_ms"), now_ms, decay) + weights[1] * freq + weights[2] * authority) / total)
    final = T.clamp(omega * F.greatest("_sim", F.lit(0.0)) * (1 + kappa * (words if words is not None else F.lit(0.0))) / (1 + kappa))
    second = first.withColumn("_most", most).withColumn("omega", omega).withColumn("final_score", final)
    rank = F.row_number().over(by_query().orderBy(F.round("final_score", 9).desc(), "collection", "id"))
    return second.withColumn("rank", rank).where(F.col("rank") <= k2).drop("_sim", "_r", "_most")


def hops(ranked: DataFrame, targets: DataFrame, eta: float = 0.5, theta: float = 0.15) -> DataFrame:
    """(query_id, id, final_score) of linked records that are not ranked themselves: the best of ``eta`` times a parent's score.

    ``ranked``: query_id, id, final_score; ``targets``: (id, target) links to records that exist.
    """
    eta = min(max(eta, 1e-6), 0.999999)
    reached = ranked.join(targets, "id").select("query_id", F.col("target").alias("id"), (eta * T.clamp(F.col("final_score"))).alias("final_score"))
    new = reached.join(ranked.select("query_id", "id"), ["query_id", "id"], "left_anti")
    return new.groupBy("query_id", "id").agg(F.max("final_score").alias("final_score")).where(F.round("final_score", 9) >= theta)


def merged(ranked: DataFrame, more: DataFrame) -> DataFrame:
    """Both, the higher score of each (query, id) counting; the first wins a tie."""
    both = ranked.select("query_id", "id", "final_score", F.lit(0).alias("hop")).unionByName(more.select("query_id", "id", "final_score", F.lit(1).alias("hop")))
    w = Window.partitionBy("query_id", "id").orderBy(F.round("final_score", 9).desc(), "hop")
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def retrieval_failed(ranked: DataFrame, floor: float = 0.15, least: int = 4, confidence: float = 0.5) -> DataFrame:
    """(query_id, fired, low_top, weak_summaries): whether to search the raw turns as well.

    Fires if a result came from the last cascade tier and the best final score is below ``floor``, or if the first
    four are all summaries of a mean confidence below one half. ``ranked``: rank, final_score, type, confidence, cascade_tier.
    """
    first = F.col("rank") <= least
    agg = ranked.groupBy("query_id").agg(
        F.coalesce(F.bool_or(F.col("cascade_tier") == 3), F.lit(False)).alias("deep"),
        F.max_by("final_score", -F.col("rank")).alias("top"),
        F.count_if(first).alias("n"),
        F.count_if(first & (F.col("type") == "summary")).alias("summaries"),
        F.avg(F.when(first, F.coalesce("confidence", F.lit(0.0)))).alias("mean"),
    )
    low, weak = F.coalesce(F.col("top"), F.lit(0.0)) < floor, (F.col("n") >= least) & (F.col("summaries") == F.col("n")) & (F.col("mean") < confidence)
    return agg.select("query_id", ((F.col("deep") & low) | weak).alias("fired"), low.alias("low_top"), weak.alias("weak_summaries"))


def raw_recovery(candidates: DataFrame, now_ms: int, query_words: Column, phrases: Column | None = None, decay: float = 1e-5) -> DataFrame:
    """final_score of raw turns: a fifth similarity, seven tenths keyword share, a tenth recency, up to 0.04 for phrases.

    Candidates of many queries should come with ``terms``, those of their text, made before they meet the queries.
    """
    terms = F.col("terms") if "terms" in candidates.columns else T.terms(F.col("text"))
    lexical = T.covered(query_words, terms)
    told = lambda normal: F.size(F.filter(phrases, lambda p: F.contains(normal, p)))
    bonus = F.least(F.lit(0.04), 0.01 * V.bound(F.concat(F.lit(" "), F.array_join(terms, " "), F.lit(" ")), told)) if phrases is not None else F.lit(0.0)
    final = T.clamp(0.2 * T.clamp(F.col("score")) + 0.7 * lexical + 0.1 * recency(F.col("ts_ms"), now_ms, decay) + bonus)
    return candidates.withColumn("lexical", lexical).withColumn("final_score", final)


# What a question about time says and how much that weighs; what anchors a text in time.
QUESTIONS = {"how many days": 1.0, "how long": 0.9, "before|after": 0.8, "since|between": 0.7, "first|earlier": 0.8, "when did": 0.7}
MONTHS = {"jan": "uary", "feb": "ruary", "mar": "ch", "apr": "il", "may": "", "jun": "e", "jul": "y", "aug": "ust", "sep": "tember", "sept": "ember", "oct": "ober", "nov": "ember", "dec": "ember"}
DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
NEAR_DAYS = ["today", "yesterday", "tomorrow"]
AFTER_LAST = ["week", "month", "year", "night", "saturday", "sunday"]
AFTER_NEXT = ["week", "month", "year", *DAYS]
QUESTION_NORM, ANCHOR_NORM = 1.5, 3.0


def _border(pattern: str) -> str:
    """The pattern, which begins and ends with ASCII word characters, between word borders."""
    return rf"(?<![0-9a-z_])(?:{pattern})(?![0-9a-z_])"


def _anchors() -> list[str]:
    """Expressions of anchors in lower-case text; each is searched by itself."""
    month = "|".join(f"{m}(?:{rest})?" if rest else m for m, rest in MONTHS.items())
    return [
        _border(r"\d{4}-\d{2}-\d{2}"),
        _border(r"\d{1,2}/\d{1,2}(?:/\d{2,4})?"),
        _border(rf"(?:{month})\s+\d{{1,2}}(?:st|nd|rd|th)?(?:,\s*\d{{4}})?"),
        _border("|".join(DAYS)),
        _border(rf"{'|'.join(NEAR_DAYS)}|last\s+(?:{'|'.join(AFTER_LAST)})|next\s+(?:{'|'.join(AFTER_NEXT)})|mid-?[a-z]+"),
        _border(r"\d{1,2}:\d{2}(?:\s?[ap]m)?"),
        _border(r"(?:19|20)\d{2}"),
        _border(r"\d{10,13}"),
    ]


def temporal_indicator(query: Column) -> Column:
    """How much a question asks about time: the weights of the kinds it shows, each once, by 1.5, at most 1."""
    lowered = F.lower(query)
    total = reduce(lambda a, b: a + b, [F.when(lowered.rlike(_border(p.replace(" ", r"\s+"))), w).otherwise(0.0) for p, w in QUESTIONS.items()])
    return T.clamp(total / QUESTION_NORM)


def anchor_density(text: Column) -> Column:
    """Different anchors of a text (in lower case), by 3, at most 1."""
    lowered = F.lower(text)
    found = F.flatten(F.array(*[F.regexp_extract_all(lowered, F.lit(p), F.lit(0)) for p in _anchors()]))
    return T.clamp(F.size(F.array_distinct(found)) / ANCHOR_NORM)


def slot_coverage(slots: Column, text: Column) -> Column:
    """Share of slots (arrays of terms) of which at least half the terms occur in the text."""
    known = lambda s, have: F.size(F.filter(s, lambda t: F.array_contains(have, t)))
    hit = lambda have: F.filter(slots, lambda s: V.bound(F.array_distinct(s), lambda d: 2 * known(d, have) >= F.size(d)))
    return F.coalesce(F.try_divide(F.size(V.bound(T.terms(text), hit)).cast("double"), F.size(slots)), F.lit(0.0))


def temporal_recovery(candidates: DataFrame, now_ms: int, decay: float = 1e-5) -> DataFrame:
    """final_score of turns for a question about time; candidates carry anchor, covered, witness, comparison and active."""
    rec, sem = recency(F.col("ts_ms"), now_ms, decay), T.clamp(F.col("score"))
    plain = 0.4 * sem + 0.25 * rec + 0.2 * F.col("anchor") + 0.15 * F.col("covered") + F.when(F.col("active"), 0.05).otherwise(0.0)
    compared = 0.15 * sem + 0.15 * rec + 0.15 * F.col("covered") + 0.55 * F.col("witness")
    return candidates.withColumn("final_score", T.clamp(F.when(F.col("comparison"), compared).otherwise(plain)))


def best_pairs(candidates: DataFrame) -> DataFrame:
    """The pair of one candidate of each side whose witness scores sum highest within the budget, for each query.

    candidates: query_id, side (0 or 1), id, witness, final_score, tokens, budget; ties go to fewer tokens, then to the earlier.
    """
    order = Window.partitionBy("query_id", "side").orderBy(F.col("witness").desc(), F.col("final_score").desc(), "tokens", "id")
    c = candidates.withColumn("pos", F.row_number().over(order))
    a, b = c.where("side = 0").alias("a"), c.where("side = 1").alias("b")
    pairs = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.id") != F.col("b.id")) & (F.col("a.tokens") + F.col("b.tokens") <= F.col("a.budget")))
    pairs = pairs.select(F.col("a.query_id").alias("query_id"), F.col("a.id").alias("first_id"), F.col("b.id").alias("second_id"), (F.col("a.witness") + F.col("b.witness")).alias("witness"), (F.col("a.tokens") + F.col("b.tokens")).alias("tokens"), F.col("a.pos").alias("pa"), F.col("b.pos").alias("pb"))
    w = by_query().orderBy(F.round("witness", 9).desc(), "tokens", "pa", "pb")
    return pairs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "pa", "pb")


def expanded_summaries(items: DataFrame, children: DataFrame, budget: Column | int, least: float = 0.7, penalty: float = 0.85) -> DataFrame:
    """What confident summaries stand for, as far as a token budget goes: (query_id, parent, id, final_score, depth, used).

    items: query_id, rank, id, type, confidence, expansion_depth. children: parent, child_order, id, score (or final score), token_estimate; those
    without an estimate above 0 are left out. Children are taken in the order of their summaries, those over what is left are skipped.
    """
    ok = items.where((F.col("type") == "summary") & (F.coalesce("confidence", F.lit(0.0)) >= least)).select("query_id", F.col("rank").alias("_rank"), F.col("id").alias("parent"), (F.coalesce("expansion_depth", F.lit(0)) + 1).alias("depth"))
    listed = ok.join(children.where("token_estimate > 0"), "parent").withColumn("tokens", F.greatest(F.floor("token_estimate"), F.lit(1)).cast("long"))
    listed = listed.withColumn("_at", F.row_number().over(by_query().orderBy("_rank", "child_order", "id"))).withColumn("_key", F.col("_at").cast("string"))
    fit = pack.first_fit(listed, budget, order="_at", key="_key").select("query_id", F.col("_key"), "used")
    return listed.join(fit, ["query_id", "_key"]).select("query_id", "parent", "id", T.clamp(F.col("score") * penalty).alias("final_score"), "depth", "used")


def stability(role: Column, gate: Column) -> Column:
    """How stable a kept turn is: the weight of its role, or its gate score if that is higher."""
    return F.greatest(role_weight(role), F.coalesce(gate, F.lit(0.0)))


def role_weight(role: Column) -> Column:
    return F.when(role == "user", 0.5).when(role == "assistant", 0.25).otherwise(0.2)
