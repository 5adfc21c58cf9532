"""A memory of records in versioned Parquet: writes, searches, the gate, compaction and housekeeping, each a Spark job.

Every call takes and gives DataFrames of many rows. Writes name no version: they are made
against the newest one and raise ``commit.Conflict`` if another write came between.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vector as V
from .operators import authored, commit, compact, gate, protect, rank, retrieve, store

RECORD = "collection string, id string, text string, vector array<double>, ts_ms long, role string, session_id string, user_ns string, type string, access_count long, stability_weight double, metadata map<string,string>"
JOURNAL = "id string, ts_ms long, session_id string, hook string, reason string"


class Memory:
    def __init__(self, spark: SparkSession, root: str, embed: Callable[[Column], Column] = V.hashed_embedding, dims: int = 32):
        self.spark, self.embed, self.dims = spark, embed, dims
        self.store = commit.Store(spark, root)
        self.fingerprint = f"{getattr(embed, '__name__', 'embed')}:{dims}"

    # reading

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.store.read(name) if name in self.store.tables() else self.spark.createDataFrame([], schema)

    def records(self) -> DataFrame:
        return self._table("records", RECORD)

    def list_collection(self, name: str) -> DataFrame:
        return self.records().where(F.col("collection") == name).orderBy("id")

    def list_by_meta(self, name: str, key: str, value: str) -> DataFrame:
        column = F.col(key).cast("string") if key in self.records().columns else F.col("metadata")[key]
        return self.records().where((F.col("collection") == name) & (column == value))

    def status(self) -> DataFrame:
        """Rows of each kind of collection."""
        return self.records().groupBy(F.substring_index("collection", ":", 1).alias("scope")).agg(F.count("*").alias("n"))

    def export(self, prefix: str) -> DataFrame:
        return store.exported(self.records(), prefix)

    # writing

    def _filled(self, rows: DataFrame) -> DataFrame:
        """Rows with all columns of a record, embedded where they have no vector, of the right dimension."""
        for field in RECORD.split(", "):
            name, kind = field.split(" ", 1)
            if name not in rows.columns:
                rows = rows.withColumn(name, F.lit(None).cast(kind))
        rows = rows.withColumn("vector", F.coalesce("vector", self.embed(F.coalesce("text", F.lit(""))))).withColumn("access_count", F.coalesce("access_count", F.lit(0)))
        return store.checked(rows.select(*[F.col(f.split(" ", 1)[0]).cast(f.split(" ", 1)[1]) for f in RECORD.split(", ")]), self.dims)

    def _guard(self) -> dict[str, DataFrame]:
        """The fingerprint of the embedding: stored with the first write, the same for all others."""
        if "embedding" in self.store.tables():
            if self.store.read("embedding").first()[0] != self.fingerprint:
                raise ValueError("records of another embedding")
            return {}
        return {"embedding": self.spark.createDataFrame([(self.fingerprint,)], "fingerprint string")}

    def insert(self, rows: DataFrame) -> int:
        """Records of (collection, id, text, ...); equal (collection, id) are replaced."""
        version, new = self.store.version(), self._filled(rows)
        if "records" not in self.store.tables():
            return self.store.commit({"records": new} | self._guard(), version)
        known = self.records().join(new.select("collection", "id").distinct(), ["collection", "id"], "left_semi")
        if known.isEmpty():
            return self.store.commit(self._guard(), version, {"records": new})
        return self.store.commit({"records": store.replaced(self.records(), new, ["collection", "id"])} | self._guard(), version)

    def insert_turns(self, turns: DataFrame) -> int:
        """Turns into the active view and the raw history at once, and into the index of their user."""
        both = store.dual_write(turns)
        index = turns.where("role = 'user' and user_ns is not null").withColumn("collection", F.concat(F.lit("turns:"), F.col("user_ns").cast("string")))
        return self.insert(both.drop("raw_history", "active_view").unionByName(index))

    def delete(self, keys: DataFrame) -> int:
        version = self.store.version()
        return self.store.commit({"records": self.records().join(keys.select("collection", "id").distinct(), ["collection", "id"], "left_anti")}, version)

    def flush_namespace(self, prefix: str, exact: bool = False) -> int:
        version = self.store.version()
        return self.store.commit({"records": store.flushed(self.records(), prefix, exact)}, version)

    def delete_collections(self, prefix: str) -> int:
        """Deletes all collections whose name begins with the prefix."""
        version = self.store.version()
        return self.store.commit({"records": store.without_collections(self.records(), prefix)}, version)

    def bump_access_counts(self, used: DataFrame) -> int:
        version = self.store.version()
        return self.store.commit({"records": store.bumped(self.records(), used).select(*self.records().columns)}, version)

    def ingest_markdown(self, docs: DataFrame) -> int:
        """Authored documents (source_doc, text): their nodes replace those of the same document in all tiers."""
        tiers = F.when(F.col("tier") == 1, "authored:hard").when(F.col("tier") == 2, "authored:soft").otherwise("authored:variant")
        nodes = authored.nodes(docs)
        meta = F.create_map(*[x for c in ("source_doc", "kind", "tier", "ordinal", "position", "modality_mask", "token_estimate") for x in (F.lit(c), F.col(c).cast("string"))], F.lit("hop_targets"), F.array_join("hop_targets", ","))
        rows = self._filled(nodes.select(tiers.alias("collection"), F.format_string("%s#%06d", "source_doc", "ordinal").alias("id"), "text", F.col("kind").alias("type"), meta.alias("metadata")))
        version = self.store.version()
        old = self.records()
        gone = docs.select(F.col("source_doc").alias("_doc")).distinct()
        kept = old.join(gone, old.collection.startswith("authored:") & (old.metadata["source_doc"] == gone["_doc"]), "left_anti")
        return self.store.commit({"records": kept.unionByName(rows)} | self._guard(), version)

    def promote(self, entries: DataFrame, user: str) -> int:
        """Diary entries (source_doc, line, text, score, recall_count, unique_queries) that pass, into the user's dreams."""
        ok = store.promoted(entries)
        return self.insert(ok.select(F.lit(f"dream:{user}").alias("collection"), "id", "text", F.lit("dream_promotion").alias("type"), F.create_map(F.lit("source_doc"), "source_doc").alias("metadata")))

    def hint(self, rows: DataFrame, most: int = 500) -> int:
        """Lifecycle hints into the journal, of which the newest ``most`` stay."""
        version = self.store.version()
        both = self._table("journal", JOURNAL).unionByName(rows.select("id", "ts_ms", "session_id", "hook", "reason"))
        return self.store.commit({"journal": store.journal_pruned(both, most)}, version)

    def journal(self, session_id: str, most: int) -> DataFrame:
        return self._table("journal", JOURNAL).where(F.col("session_id") == session_id).orderBy("id").limit(most)

    # searching

    def search(self, queries: DataFrame, collections: list[str], k: int = 8, excluded: DataFrame | None = None) -> DataFrame:
        """(query_id, rank, id, collection, score, text) of many text queries (query_id, text) over some collections; excluded (collection, id) never take a place. Ties go by collection and id."""
        rows = self.records().where(F.col("collection").isin(collections))
        if excluded is not None:
            rows = rows.join(excluded.select("collection", "id").distinct(), ["collection", "id"], "left_anti")
        asked = queries.select("query_id", self.embed(F.col("text")).alias("vector"))
        found = retrieve.top_k_over_collections(rows.select("id", "vector", "collection"), asked, k, exclude_self=False)
        return found.join(rows.select("collection", "id", "text", "ts_ms", "role", "type", "access_count"), ["collection", "id"])

    def search_raw(self, queries: DataFrame, session_id: str, k: int = 8) -> DataFrame:
        return self.search(queries, [f"session_raw:{session_id}"], k)

    def _of_users(self, kind: str, users: DataFrame) -> DataFrame:
        """(id, vector, user_ns, ts_ms) of these users' records of a kind of collection; those without a time count as older than any other."""
        rows = self.records().where(F.col("collection").startswith(f"{kind}:")).withColumn("user_ns", F.expr(f"substring(collection, {len(kind) + 2})"))
        return rows.join(users, "user_ns", "left_semi").select("id", "vector", "user_ns", F.coalesce("ts_ms", F.lit(-(1 << 62))).alias("ts_ms"))

    def gate(self, turns: DataFrame) -> DataFrame:
        """Users' turns (id, text, user_ns, ts_ms) with all signals, h, r and g, as of each turn: its user's turns up to it, itself included, and the
        user's memories from before it, whether they are stored already or in ``turns`` too."""
        asked = turns.withColumn("user_ns", F.col("user_ns").cast("string")).withColumn("vector", self.embed(F.coalesce("text", F.lit(""))))
        users = asked.select("user_ns").distinct()
        now = asked.select("id", "vector", "user_ns", "ts_ms")
        new = lambda kind, named: store.replaced(self._of_users(kind, users), now.withColumn("id", named), ["user_ns", "id"])
        scored = gate.scored_as_of(asked, new("turns", F.col("id")), new("user", F.concat("user_ns", F.lit(":"), "id")))
        return scored.drop("vector")

    def ingest(self, turns: DataFrame) -> int:
        """Turns into session and raw history, those of users into the turn index and, with their gate scores, into their durable memory.

        The gate marks and does not filter. Each turn is scored after it and those before it came into the index, and those before it into the memory.
        """
        said = turns.where("role = 'user' and user_ns is not null")
        scores = ["g", "t", "h", "r", "d", "p", "a", "dtech", "gconv", "gtech"]
        scored = self.gate(said)
        weight = rank.stability(F.col("role"), F.col("g"))
        meta = F.create_map(*[x for c in scores for x in (F.lit("gating_score" if c == "g" else f"gating_{c}"), F.col(c).cast("string"))], F.lit("stability_weight"), weight.cast("string"), F.lit("source_turn_id"), F.col("id"), F.lit("provenance_class"), F.lit("durable_user_memory"))
        durable = scored.select(F.concat(F.lit("user:"), F.col("user_ns").cast("string")).alias("collection"), F.concat(F.col("user_ns").cast("string"), F.lit(":"), "id").alias("id"), "text", "role", "ts_ms", "session_id", F.lit("turn").alias("type"), meta.alias("metadata"))
        both = self._filled(store.dual_write(turns).drop("raw_history", "active_view"))
        index = self._filled(said.withColumn("collection", F.concat(F.lit("turns:"), F.col("user_ns").cast("string"))))
        return self.insert(both.unionByName(index).unionByName(self._filled(durable)))

    # compaction

    def compact(self, sessions: list[str], target: int = 20, model: compact.Summariser | None = None) -> DataFrame:
        """Summaries, coverage edges and guidance shards of the sessions' older turns, in one commit; gives the result of each session.

        Buckets of turns that the gate holds worth it (``gating_score`` of their metadata) go to the ``model``, if there is one.
        """
        version = self.store.version()
        turns = self.records().where(F.col("collection").isin([f"session:{s}" for s in sessions]))
        dealt = compact.older_buckets(turns, target)
        marked = protect.protected(dealt)
        # Large code blocks and encoded lines give way to placeholders before anything is summarised.
        clean = marked.where("protection is null").withColumn("text", protect.sanitised(F.col("text"))).withColumn("gating_score", F.col("metadata")["gating_score"].try_cast("double"))
        made = protect.ladder(clean, embed=self.embed, model=model).where("accepted")
        rows = made.select(F.concat(F.lit("session_summary:"), "session_id").alias("collection"), "id", "text", F.col("end_ms").alias("ts_ms"), "session_id", F.lit("summary").alias("type"), F.create_map(F.lit("confidence"), F.col("confidence").cast("string"), F.lit("decay_rate"), F.col("decay_rate").cast("string")).alias("metadata"))
        kept = protect.shards(marked).select("collection", "id", "text", F.col("source_turn_ts").alias("ts_ms"), "type", F.create_map(F.lit("protection_reason"), "protection_reason").alias("metadata"))
        new = self._filled(rows).unionByName(self._filled(kept))
        out = {"records": store.replaced(self.records(), new, ["collection", "id"]), "edges": compact.edges(made)}
        if "edges" in self.store.tables():
            out["edges"] = store.replaced(self.store.read("edges"), out["edges"], ["parent_summary_id", "child_id"])
        result = compact.result(made)
        self.store.commit(out | self._guard(), version)
        return result

    def expand(self, summary_ids: DataFrame, depth: int = 3) -> DataFrame:
        """Turns and summaries below summaries, down to ``depth``, with their text."""
        found = compact.expanded(self.store.read("edges"), summary_ids, depth)
        texts = self.records().where(F.col("collection").rlike("^session(?:_raw|_summary)?:")).dropDuplicates(["id"]).select(F.col("id").alias("child_id"), "text")
        return found.join(texts, "child_id")

    def ranked(self, queries: DataFrame, collections: list[str], now_ms: int, k: int = 16) -> DataFrame:
        """Search and the two-pass rank in one."""
        found = self.search(queries, collections, k).withColumn("authority", F.lit(None).cast("double")).withColumn("authored", F.col("collection").startswith("authored:"))
        return rank.two_pass(found, now_ms)
