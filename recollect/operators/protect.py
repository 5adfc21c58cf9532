"""What compaction keeps word for word, what it cleans before summarising, and how it accepts a summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from . import compact
from .modality import mask

# Words of advice, and prototypes of advice that should survive. A turn with such a word is protected if it lies near a prototype.
ADVICE = ["prefer", "prioritise", "prioritize", "focus", "avoid", "reject", "keep", "ensure", "consider", "should", "must", "never", "do not", "don't", "use"]
PROTOTYPES = [
    "Prefer deterministic operational guidance over generic defaults.",
    "Avoid unsafe or undesired implementation choices in hot paths.",
    "Use the specified approach when implementing core project logic.",
    "Keep the implementation aligned with project-specific engineering rules.",
]
HINT = rf"(?i)\b(?:{'|'.join(ADVICE)})\b"


def protected(turns: DataFrame, embed=V.hashed_embedding, floor: float = 0.35, near: float = 0.78) -> DataFrame:
    """Turns (text, vector, stability_weight) with ``protection``: "sigma" for an instruction, "booster" for advice near a prototype, else null.

    Only turns that aren't blank and whose stability is ``floor`` or more are considered.
    """
    protos = F.array(*[embed(F.lit(p)) for p in PROTOTYPES])
    closest = F.array_max(F.transform(protos, lambda p: V.cosine(F.col("vector"), p)))
    able = (F.trim(F.coalesce("text", F.lit(""))) != "") & (F.coalesce("stability_weight", F.lit(0.0)) >= floor)
    kind = F.when(mask(F.col("text")) != 0, "sigma").when(T.matches(F.col("text"), HINT) & (F.round(closest, 9) >= near), "booster")
    return turns.withColumn("protection", F.when(able, kind))


def shards(rows: DataFrame) -> DataFrame:
    """Guidance shards of the protected turns, into the elevated collection of the user, or of the session without one."""
    place = F.coalesce(F.concat(F.lit("elevated:user:"), F.col("user_ns").cast("string")), F.concat(F.lit("elevated:session:"), F.col("session_id").cast("string")))
    return rows.where("protection is not null").select(place.alias("collection"), F.concat(F.lit("shard:"), "id").alias("id"), "text", F.lit("guidance_shard").alias("type"), F.col("protection").alias("protection_reason"), F.lit(True).alias("elevated_guidance"), F.col("ts_ms").alias("source_turn_ts"))


def sanitised(text: Column) -> Column:
    """Text for a summariser: large fenced blocks and encoded lines give way to a placeholder, blank runs to one; an empty text to one as well."""
    block = F.regexp_replace(text, r"(?s)(?m)^[ \t]*(```|~~~)[^\n]*\n(?:(?!^[ \t]*\1).){240,}?^[ \t]*\1[^\n]*$", "[code block left out]")
    block = F.regexp_replace(block, r"(?m)^[ \t]*(```|~~~)[^\n]*\n(?:(?![ \t]*\1)[^\n]*\n){8,}?[ \t]*\1[^\n]*$", "[code block left out]")
    line = lambda x: F.when((F.octet_length(x) >= 64) & F.ltrim(x).startswith("data:") | (F.octet_length(x) >= 96) & x.rlike(r"[A-Za-z0-9+/=_-]{80,}|[0-9a-fA-F]{64,}"), "[encoded data left out]").otherwise(x)
    flat = F.array_join(F.transform(F.split(block, "\n"), line), "\n")
    flat = F.regexp_replace(F.regexp_replace(flat, r"\n[ \t]*(?:\n[ \t]*)+\n", "\n\n"), r"^\s+|\s+$", "")
    return F.when(flat == "", "[no text]").otherwise(flat)


def ladder(dealt: DataFrame, densities: tuple[float, float] = (0.4, 0.25), embed=V.hashed_embedding, model: compact.Summariser | None = None) -> DataFrame:
    """The first summary of each bucket, of those made denser and denser, that is shorter than its sources; declined if none is."""
    return compact.escalated(dealt, model, densities, embed)
