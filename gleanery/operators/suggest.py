"""Suggestions of umbrella pages: what a new record's names and the whole history have in common, unless it was rejected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators.knowledge import CLUSTER_SUFFIXES, common_prefix, confidence, signature

#: Names of one first word that make a pattern at least, characters of their prefix, and sources of a suffix.
SIBLINGS, PREFIX, SOURCES = 3, 5, 2
CUTOFF = 0.6


def appended(history: DataFrame, new: DataFrame) -> DataFrame:
    """history (source, at, slug) with the records of new; a record (source, at) that is there already stays as it is."""
    return history.unionByName(new.join(history.select("source", "at").distinct(), ["source", "at"], "left_anti"))


def prefix_patterns(new: DataFrame, least: int = SIBLINGS, length: int = PREFIX) -> DataFrame:
    """umbrella, slugs, support, shapes, mentions of names of one record that begin alike: its first word is shared by `least`
    names or more, and the prefix that all of them share, cut at its last separator, is long enough."""
    m = new.select("source", "at", "slug").distinct().withColumn("head", F.substring_index("slug", "-", 1))
    g = m.groupBy("source", "at", "head").agg(F.collect_set("slug").alias("slugs"), F.min("slug").alias("lo"), F.max("slug").alias("hi")).where(F.size("slugs") >= least)
    g = g.withColumn("umbrella", F.regexp_replace(common_prefix(F.col("lo"), F.col("hi")), "[-_][^-_]*$", "")).where(F.length("umbrella") >= length)
    shapes = F.array_distinct(F.transform("slugs", lambda s: F.substring_index(F.substring(s, F.length("umbrella") + 1, F.length(s)), "-", 1)))
    return g.select("umbrella", F.array_sort("slugs").alias("slugs"), F.lit(1).alias("support"), F.size(shapes).alias("shapes"), F.size("slugs").cast("long").alias("mentions"))


def suffix_patterns(history: DataFrame, suffixes: list[str] = CLUSTER_SUFFIXES, least: int = SOURCES) -> DataFrame:
    """The same of suffixes that names of `least` sources or more end with. A source counts with the names of its last record
    that has such names; mentions are those of all records. The umbrella begins with the names' first word if all share it."""
    s = F.explode(F.array(*[F.lit(x) for x in suffixes]))
    m = history.select("source", "at", "slug", s.alias("suffix")).where(F.col("slug").endswith(F.concat(F.lit("-"), F.col("suffix"))))
    per = m.groupBy("suffix", "source", "at").agg(F.collect_set("slug").alias("slugs"), F.count("*").alias("n"))
    last = per.groupBy("suffix", "source").agg(F.max_by("slugs", "at").alias("slugs"), F.sum("n").alias("n"))
    g = last.groupBy("suffix").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("slugs")))).alias("slugs"), F.count("*").cast("int").alias("support"), F.sum("n").alias("mentions"))
    heads = F.array_distinct(F.transform("slugs", lambda x: F.substring_index(x, "-", 1)))
    umbrella = F.concat(F.when(F.size(heads) == 1, F.get(heads, 0)).otherwise("cluster"), F.lit("-"), "suffix")
    return g.where(F.col("support") >= least).select(umbrella.alias("umbrella"), "slugs", "support", F.lit(1).alias("shapes"), "mentions")


def detected(history: DataFrame, new: DataFrame, barred: DataFrame, builtin: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """id, umbrella, slugs, support, mentions, confidence: patterns of the new records and of the history with them, but for
    those whose id is barred (id) or whose confidence is too low. builtin (slug): names that a built-in umbrella has already;
    a pattern with one of them is less sure. A pattern found twice comes once. Names of a pattern are one value; there are as
    many as a record, or the names of a suffix, have."""
    every = prefix_patterns(new).unionByName(suffix_patterns(appended(history, new)))
    every = every.withColumn("id", signature(F.col("umbrella"), F.col("slugs")))
    known = every.select("id", F.explode("slugs").alias("slug")).join(builtin.select("slug").distinct(), "slug", "left_semi").select("id").distinct().withColumn("known", F.lit(True))
    every = every.join(barred.select("id").distinct(), "id", "left_anti").join(known, "id", "left")
    sure = confidence(F.col("support"), F.col("shapes"), F.col("mentions"), F.coalesce("known", F.lit(False)))
    rows = every.withColumn("confidence", sure).where(F.col("confidence") >= cutoff)
    return rows.groupBy("id").agg(F.max(F.struct("confidence", "umbrella", "slugs", "support", "mentions")).alias("r")).select("id", "r.umbrella", "r.slugs", "r.support", "r.mentions", "r.confidence")
