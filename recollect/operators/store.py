"""Mutations of the record table as new DataFrames: replace, delete, flush, bump, journal, promote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V


def replaced(records: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Records with those of equal keys replaced by the new ones."""
    return records.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def dual_write(turns: DataFrame) -> DataFrame:
    """Each turn once for the active view and once for the raw history."""
    sid = F.col("session_id").cast("string")
    active = turns.withColumn("collection", F.concat(F.lit("session:"), sid)).withColumn("raw_history", F.lit(False)).withColumn("active_view", F.lit(True))
    raw = turns.withColumn("collection", F.concat(F.lit("session_raw:"), sid)).withColumn("raw_history", F.lit(True)).withColumn("active_view", F.lit(False))
    return active.unionByName(raw)


def checked(records: DataFrame, dims: int) -> DataFrame:
    """The records; a vector of another size fails the job."""
    wrong = F.size("vector") != dims
    return records.withColumn("vector", F.when(wrong, F.raise_error(F.lit("a vector of another dimension"))).otherwise(F.col("vector")))


def flushed(records: DataFrame, prefix: str, exact: bool = False) -> DataFrame:
    """Records left after a namespace is flushed: by string prefix (user:u1 also takes user:u10), or of exactly that name."""
    if prefix.rstrip() in ("", "user:"):
        raise ValueError("a whole scope can't be flushed")
    c = F.col("collection")
    return records.where(~((c == prefix) | (F.lit(not exact) & c.startswith(prefix))))


def exported(records: DataFrame, prefix: str) -> DataFrame:
    """Records of a collection, or of those below its name, as JSON lines with their metadata (left out where there is none)."""
    c = F.col("collection")
    fields = [f for f in ("collection", "id", "text", "metadata") if f in records.columns]
    return records.where((c == prefix) | c.startswith(prefix + ":")).select(F.to_json(F.struct(*fields)).alias("value"))


def bumped(records: DataFrame, used: DataFrame) -> DataFrame:
    """access_count one higher for each record of the distinct (collection, id) pairs used."""
    hit = used.where(F.col("id").cast("string") != "").select("collection", "id").distinct().withColumn("_hit", F.lit(1))
    out = records.join(hit, ["collection", "id"], "left")
    return out.withColumn("access_count", F.coalesce("access_count", F.lit(0)) + F.coalesce("_hit", F.lit(0))).drop("_hit")


def journal_pruned(journal: DataFrame, most: int, partition: Column | None = None) -> DataFrame:
    """The newest ``most`` rows by (ts, id), of each partition if one is given; 0 or less keeps all."""
    if most <= 0:
        return journal
    if partition is None:
        return journal.orderBy(F.desc("ts_ms"), F.desc("id")).limit(most)
    w = Window.partitionBy(partition).orderBy(F.desc("ts_ms"), F.desc("id"))
    return journal.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def promoted(entries: DataFrame, score: float = 0.6, recall: int = 2, unique: int = 2, least_bytes: int = 16) -> DataFrame:
    """Diary entries that are promoted, with ids by their number within the document."""
    ok = (F.octet_length(F.trim("text")) >= least_bytes) & (F.col("score") >= score) & (F.col("recall_count") >= recall) & (F.col("unique_queries") >= unique)
    at = F.row_number().over(Window.partitionBy("source_doc").orderBy("line")) - 1
    return entries.where(F.coalesce(ok, F.lit(False))).withColumn("id", F.format_string("%s#dream#%06d", F.col("source_doc"), at))


def missing_tiers(full: DataFrame, tiers: DataFrame) -> DataFrame:
    """Ids of full vectors that a tier lacks: (id, tier)."""
    wanted = full.select("id").withColumn("tier", F.explode(F.array(F.lit(64), F.lit(256))))
    return wanted.join(tiers.select("id", "tier"), ["id", "tier"], "left_anti")


def in_tiers(records: DataFrame, sizes: tuple[int, ...] = (64, 256)) -> DataFrame:
    """Records (collection, id, vector) with a row more for each tier: the vector's prefix at length 1, in the collection's tier of that name.

    ``dirty``: the vector is too short for the tier, whose row is then a mark (no vector) for a later repair.
    """
    out = records.select("collection", "id", "vector", F.lit(False).alias("dirty"))
    for n in sizes:
        fits = F.size("vector") >= n
        out = out.unionByName(records.select(F.concat("collection", F.lit(f":{n}d")).alias("collection"), "id", F.when(fits, V.prefix(F.col("vector"), n)).alias("vector"), (~F.coalesce(fits, F.lit(False))).alias("dirty")))
    return out


def repaired(tiered: DataFrame, marks: DataFrame, sizes: tuple[int, ...] = (64, 256)) -> DataFrame:
    """The tiered records with the rows that marks (collection, id, tier) ask for put in their places; marks of unknown tiers or of
    records that are gone are dropped."""
    base = tiered.where(~F.col("collection").rlike(r":\d+d$"))
    asked = marks.where(F.col("tier").isin(*sizes)).select("collection", "id", "tier").distinct().join(base.select("collection", "id", "vector"), ["collection", "id"])
    sized = F.coalesce(*[F.when((F.col("tier") == n) & (F.size("vector") >= n), V.prefix(F.col("vector"), n)) for n in sizes])
    new = asked.select(F.concat("collection", F.lit(":"), F.col("tier").cast("string"), F.lit("d")).alias("collection"), "id", sized.alias("vector")).where("vector is not null").withColumn("dirty", F.lit(False))
    return replaced(tiered, new, ["collection", "id"])


def without_collections(records: DataFrame, prefix: str) -> DataFrame:
    """Records left after all collections whose name begins with the prefix are deleted (an empty prefix deletes none)."""
    return records if not prefix else records.where(~F.col("collection").startswith(prefix))


def authored_records(nodes: DataFrame, embed) -> DataFrame:
    """Authored nodes (source_doc, ordinal, tier, text, ...) as records of their tier's collection: only variants are searched for, so those of the others
    have a vector of one zero."""
    tier = F.when(F.col("tier") == 1, "authored:hard").when(F.col("tier") == 2, "authored:soft").otherwise("authored:variant")
    vector = F.when(F.col("tier") == 0, embed(F.col("text"))).otherwise(F.array(F.lit(0.0)))
    return nodes.withColumn("collection", tier).withColumn("id", F.format_string("%s#%06d", "source_doc", F.col("ordinal").cast("int"))).withColumn("vector", vector)


def authored_replaced(records: DataFrame, docs: DataFrame, new: DataFrame) -> DataFrame:
    """Records (collection, source_doc, ...) with all nodes of the documents (source_doc), in whatever tier, replaced by the new ones."""
    gone = docs.select("source_doc").distinct().withColumn("_authored", F.lit(True))
    kept = records.withColumn("_authored", F.col("collection").startswith("authored:")).join(gone, ["source_doc", "_authored"], "left_anti")
    return kept.select(*records.columns).unionByName(new.select(*records.columns))
