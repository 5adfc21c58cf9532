"""Sources in files: Markdown trees, diaries, benchmark instances, JSON lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def glob_pattern(glob: str) -> str:
    """A glob as an anchored pattern: * stands for any characters, everything else for itself."""
    return "^" + ".*".join(re.escape(p) for p in glob.split("*")) + "$"


def wanted(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Whether a relative path is taken: not excluded, and included (all are, without a list); memory.md always."""
    hit = lambda globs: F.coalesce(*[F.when(path.rlike(glob_pattern(g)), True) for g in globs], F.lit(False)) if globs else F.lit(False)
    name = F.lower(F.substring_index(path, "/", -1))
    return ~hit(exclude) & (hit(include) | F.lit(not include) | (name == "memory.md"))


def markdown(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """(path below root, text, size, mtime_ms) of the Markdown files of a tree."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,markdown}").load(root)
    base = "/" + re.sub(r"^[a-z0-9]+:/*", "", root).strip("/") + "/"
    path = F.element_at(F.split(F.col("path"), re.escape(base), 2), 2)
    rows = files.select(path.alias("path"), F.decode("content", "UTF-8").alias("text"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"))
    return rows.where(wanted(F.col("path"), list(include), list(exclude)))


def without_fences(text: Column) -> Column:
    """The text's lines outside code fences."""
    step = lambda s, line: F.when(F.ltrim(line).rlike("^(?:```|~~~)"), F.struct((~s["open"]).alias("open"), s["kept"].alias("kept"))).otherwise(F.struct(s["open"].alias("open"), F.when(s["open"], s["kept"]).otherwise(F.concat(s["kept"], F.array(line))).alias("kept")))
    start = F.struct(F.lit(False).alias("open"), F.array().cast("array<string>").alias("kept"))
    return F.array_join(F.aggregate(F.split(text, "\n"), start, step)["kept"], "\n")


def eligible_note(text: Column, keys: tuple[str, ...] = ("tags", "tag", "memory")) -> Column:
    """A note is taken if its frontmatter names one of the keys, or if it has an inline #tag outside fences and headings."""
    front = F.regexp_extract(text, r"(?s)\A---\n(.*?\n)(?:---|\.\.\.)", 1)
    named = front.rlike(rf"(?m)^\s*(?:{'|'.join(keys)}):")
    rest = F.regexp_replace(text, r"(?s)\A---\n.*?\n(?:---|\.\.\.)\n", "")
    return named | without_fences(rest).rlike(r"(?m)^(?!\s*#)[^\n]*(?:^|\s)#[A-Za-z][\w/-]*") | F.lit(False)


def diary(notes: DataFrame) -> DataFrame:
    """Entries of diaries (source_doc, text): bullets with trailing {score= recall= unique=} below a heading about dreams, deep sleep or promotion.

    Lines are rows; the heading above and whether a line lies in a fence follow from windows over them.
    """
    lines = notes.select("source_doc", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "line"))
    before = Window.partitionBy("source_doc").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    fence = F.ltrim("line").rlike("^(?:```|~~~)")
    lines = lines.withColumn("fence", fence).withColumn("inside", F.coalesce(F.sum(fence.cast("int")).over(before), F.lit(0)) % 2 == 1)
    name = F.lower(F.trim(F.regexp_replace(F.regexp_extract(F.ltrim("line"), r"^#{2,6}\s+(.+)$", 1), r"\s+", " ")))
    head = F.when(~F.col("fence") & ~F.col("inside") & (name != ""), name)
    lines = lines.withColumn("section", F.last(head, ignorenulls=True).over(before)).withColumn("head", head)
    body = F.rtrim(F.regexp_extract("line", r"^\s*[-*+]\s+(.+)$", 1))
    found = lines.where(~F.col("fence") & ~F.col("inside") & F.col("head").isNull() & F.col("section").rlike("deep sleep|promot|dream")).withColumn("body", body)
    fields = F.lower(F.regexp_extract("body", r"\{([^{]*)\}$", 1))
    value = lambda names, number: F.regexp_extract(fields, rf"(?:^|[,\s])(?:{names})=({number})", 1)
    out = found.select(
        "source_doc", F.trim(F.regexp_extract("body", r"^(.*)\{[^{]*\}$", 1)).alias("text"),
        value("score", r"[-+]?[0-9]*\.?[0-9]+").try_cast("double").alias("score"),
        F.coalesce(F.nullif(value("recall", "[-+]?[0-9]+"), F.lit("")), value("recallcount", "[-+]?[0-9]+")).try_cast("int").alias("recall_count"),
        F.coalesce(F.nullif(value("unique", "[-+]?[0-9]+"), F.lit("")), value("uniquequeries", "[-+]?[0-9]+")).try_cast("int").alias("unique_queries"),
        "section", (F.col("n") + 1).alias("line"),
    )
    return out.where("text <> '' and score is not null and recall_count is not null and unique_queries is not null")


def instances(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark instances of JSON documents: an array of them, or an object that holds it as data, instances, questions or items."""
    whole = spark.read.text(path, wholetext=True)
    listed = F.when(F.ltrim("value").startswith("["), F.col("value"))
    wrapped = [F.get_json_object("value", f"$.{k}") for k in ("data", "instances", "questions", "items")]
    item = "struct<question_id:string,question_type:string,question:string,answer:string,haystack_session_ids:array<string>,haystack_sessions:array<array<struct<role:string,content:string,has_answer:boolean>>>,answer_session_ids:array<string>>"
    return whole.select(F.explode(F.from_json(F.coalesce(listed, *wrapped), f"array<{item}>")).alias("i")).select("i.*")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
