"""Readers: folders of texts, key=value settings, cost logs, tolerant JSON stores, benchmark lines, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that a scan leaves out (fixed values), besides hidden ones.
SKIPPED = ("node_modules", ".git", ".cache", "vendor", "dist", "build")


def scan(spark: SparkSession, root: str, glob: str = "*.md", ignore: list[str] = ()) -> DataFrame:
    """path (from root), doc, hash, modified of the files below root; hidden and skipped folders, ignored patterns and
    blank files are left out."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + root.replace("file:", "").rstrip("/") + "/", "")
    d = d.select(rel.alias("path"), F.decode("content", "UTF-8").alias("doc"), F.col("modificationTime").alias("modified"))
    d = d.where(~F.col("path").rlike(r"(^|/)\.") & ~F.col("path").rlike("(^|/)(" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + ")/"))
    for p in ignore:
        from gleanery.operators.paths import glob_regex

        d = d.where(~F.col("path").rlike(glob_regex(p)))
    return d.where(F.trim("doc") != "").withColumn("hash", F.sha2("doc", 256))


def settings(spark: SparkSession, path: str) -> DataFrame:
    """key, value of key = value lines; blank lines and comments do not count, a trailing comment is cut off, of a key
    given twice the last line holds."""
    r = r"^\s*([^=#\s][^=#]*?)\s*=\s*(.*?)\s*(?:#.*)?$"
    l = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("i"))
    kv = l.select("i", F.regexp_extract("value", r, 1).alias("key"), F.regexp_extract("value", r, 2).alias("value")).where("key <> ''")
    return kv.groupBy("key").agg(F.max_by("value", "i").alias("value"))


def cost_log(spark: SparkSession, path: str) -> DataFrame:
    """date, provider, task, description, tokens_in, tokens_out of '## [date] provider | task | description' blocks."""
    b = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"\n(?=## \[)")).alias("b"))
    g = lambda p, k=1: F.regexp_extract("b", p, k)
    head = r"## \[([^\]]+)\]\s*([^|\n]+?)\s*\|\s*([^|\n]+?)\s*\|\s*([^\n]+)"
    n = lambda name: F.coalesce(F.nullif(F.regexp_replace(g(name + r"[^0-9\n]*([0-9,]+)"), ",", ""), F.lit("")).cast("long"), F.lit(0).cast("long"))
    return b.where(F.col("b").rlike(head)).select(g(head).alias("date"), g(head, 2).alias("provider"), g(head, 3).alias("task"), g(head, 4).alias("description"), n("input").alias("tokens_in"), n("output").alias("tokens_out"))


def json_store(spark: SparkSession, path: str, ddl: str, version: int | None = None) -> DataFrame:
    """Records of a JSON store: rows that do not parse, or have another version, are left out instead of failing."""
    raw = spark.read.text(path, wholetext=True)
    rows = raw.select(F.from_json("value", f"version INT, items ARRAY<STRUCT<{ddl}>>").alias("s"))
    rows = rows.where("s.items IS NOT NULL")
    if version is not None:
        rows = rows.where(F.coalesce(F.col("s.version"), F.lit(version)) == version)
    return rows.select(F.inline("s.items"))


def benchmark_lines(spark: SparkSession, path: str) -> DataFrame:
    """query, expected (array) of JSON lines in either form: query/expected, or messages of which the first is the query
    and the last holds one expected name a line."""
    ddl = "query STRING, expected ARRAY<STRING>, messages ARRAY<STRUCT<role: STRING, content: STRING>>"
    d = spark.read.schema(ddl).json(path)
    q = F.coalesce("query", F.get("messages", 0)["content"])
    last = F.element_at("messages", -1)["content"]
    return d.select(q.alias("query"), F.coalesce("expected", F.filter(F.split(last, "\n"), lambda x: F.trim(x) != "")).alias("expected")).where("query IS NOT NULL")


def vectors(df: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """Rows whose vector has the wanted length."""
    return df.where(F.size(column) == dim)


def event_stream(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.readStream.schema(ddl).parquet(path)
