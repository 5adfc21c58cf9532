"""Packing ranked items into token budgets, and the budgets themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefix_fit(items: DataFrame, budget: Column | int, group: str = "query_id", order: str = "rank", cost: str = "tokens") -> DataFrame:
    """The longest ranked prefix that fits: stops at the first item over the budget."""
    total = F.sum(cost).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return items.withColumn("used", total).where(F.col("used") <= budget)


def first_fit(items: DataFrame, budget: Column | int, group: str = "query_id", order: str = "rank", key: str = "id", cost: str = "tokens") -> DataFrame:
    """Items that fit one after the other, those over what is left skipped: a fold over each group's ranked list (lists are short: k results).

    A budget that is a column is the same in all rows of a group.
    """
    empty = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("ids"))
    item = F.struct(F.col(order).alias("o"), F.col(key).cast("string").alias("k"), F.col(cost).cast("long").alias("c"))
    listed = items.groupBy(group).agg(F.sort_array(F.collect_list(item)).alias("l"), F.first(F.lit(budget) if isinstance(budget, int) else budget).alias("_budget"))
    fold = F.aggregate("l", empty, lambda s, x: F.when(s["used"] + x["c"] <= F.col("_budget"), F.struct((s["used"] + x["c"]).alias("used"), F.concat(s["ids"], F.array(x["k"])).alias("ids"))).otherwise(s))
    return listed.select(group, fold.alias("s")).select(group, "s.used", F.posexplode("s.ids").alias("position", key))


def budgets(queries: DataFrame) -> DataFrame:
    """The budget algebra of one recall: total ``budget``, ``hard`` and ``tail_base`` costs, and whether recovery fired or two things are compared."""
    floor0 = lambda c: F.greatest(c, F.lit(0.0))
    q = queries.withColumn("memory", 0.25 * F.col("budget"))
    q = q.withColumn("degraded", F.col("hard") + F.col("tail_base") > F.col("memory"))
    q = q.withColumn("soft", floor0(F.least(0.3 * F.col("memory"), F.col("memory") - F.col("hard") - F.col("tail_base"))))
    q = q.withColumn("retrieval", floor0(F.col("memory") - F.col("hard") - F.col("tail_base") - F.col("soft")))
    q = q.withColumn("elevated", F.least(0.15 * F.col("memory"), F.col("retrieval")))
    base = F.least(F.greatest(F.least(F.floor(0.1 * F.col("memory")), F.lit(128)), F.lit(16)).cast("double"), F.col("memory"))
    return q.withColumn("reserve", F.when(~F.col("fired"), 0.0).when(F.col("comparison"), F.least(F.ceil(1.8 * base).cast("double"), F.col("memory"))).otherwise(base))


def best_of_each(items: DataFrame) -> DataFrame:
    """Of each (query, collection, id) the highest final score."""
    w = Window.partitionBy("query_id", "collection", "id").orderBy(F.round("final_score", 9).desc())
    return items.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def protected_pair_fit(items: DataFrame, budget: Column | int) -> DataFrame:
    """First fit with a pair of witnesses first: query_id, rank, id, tokens, witness (boolean).

    Where a query has exactly two witnesses and both fit together they are packed before all others; else all are packed in rank order.
    """
    w = Window.partitionBy("query_id")
    pair = (F.count_if("witness").over(w) == 2) & (F.sum(F.when(F.col("witness"), F.col("tokens"))).over(w) <= budget)
    ordered = items.withColumn("_pair", F.coalesce(pair, F.lit(False)))
    order = F.row_number().over(w.orderBy(F.when(F.col("_pair") & F.col("witness"), 0).otherwise(1), "rank"))
    return first_fit(ordered.withColumn("_order", order), budget, order="_order")


#: What is shown first: the sections of a recall in order.
SECTION_ORDER = ["hard", "tail_base", "soft", "tail_extension", "elevated", "variant", "recovery"]


def concatenated(items: DataFrame) -> DataFrame:
    """Items (query_id, section, rank, ...) with ``position`` in the final order of sections."""
    at = F.array_position(F.array(*[F.lit(s) for s in SECTION_ORDER]), F.col("section"))
    return items.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(at, "rank")))


def reserve_checked(costs: DataFrame, budget: Column | int) -> DataFrame:
    """Hard items' costs by query; a reserve larger than the budget fails the job."""
    total = costs.groupBy("query_id").agg(F.sum("tokens").alias("reserved"))
    return total.withColumn("reserved", F.when(F.col("reserved") > budget, F.raise_error(F.lit("hard items exceed the startup reserve"))).otherwise(F.col("reserved")))
