"""Which texts contain which patterns, by grams and a check: no pair is looked at that does not share the pattern's rarest gram.

A gram is anything that a text must have if it has the pattern: q characters in a row, or a word inside the pattern. For
each pattern the gram that the fewest texts have is its only key; a pattern with a gram that no text has is in none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.sources.shared import written

#: Values of a side that may be broadcast, in bytes of its columns.
SMALL = 16 << 20


def small(side: DataFrame) -> DataFrame:
    """side, a written table, for broadcast if its strings and numbers take SMALL bytes at most."""
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 16 for c in side.columns), F.lit(0))
    n = side.agg(F.sum(width.cast("long"))).first()[0] or 0
    return F.broadcast(side) if n <= SMALL else side


def characters(q: int) -> Callable[[Column], Column]:
    """Distinct runs of q characters; none in shorter strings."""
    return lambda s: F.when(F.length(s) >= q, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - (q - 1)), lambda i: F.substring(s, i, F.lit(q))))).otherwise(F.array().cast("array<string>"))


def inner_words(text: Column) -> Column:
    """Distinct words between blanks, but for the first and the last, which may be parts of words of a longer text."""
    w = F.split(text, r"\s+", -1)
    return F.array_distinct(F.when(F.size(w) > 2, F.slice(w, 2, F.size(w) - 2)).otherwise(F.array().cast("array<string>")))


def all_words(text: Column) -> Column:
    return F.array_distinct(F.split(text, r"\s+", -1))


def containing(texts: DataFrame, patterns: DataFrame, of_text: Callable[[Column], Column], of_pattern: Callable[[Column], Column] | None = None) -> DataFrame:
    """text_id, pattern_id of all texts (text_id, text) that contain a pattern (pattern_id, pattern). Each id once on its
    side. Patterns without a gram are compared with every text, as every text may have them: they are meant to be few.
    Null texts and patterns match nothing, an empty pattern everything."""
    patterns = patterns.where("pattern IS NOT NULL").select("pattern_id", "pattern", (of_pattern or of_text)(F.col("pattern")).alias("grams"))
    texts = texts.where("text IS NOT NULL").select("text_id", "text")
    wanted = written(patterns.select("pattern_id", F.explode("grams").alias("gram")), "pattern-grams")
    asked = small(written(wanted.select("gram").distinct(), "asked-grams"))
    # the texts are read once to count grams, which takes partial sums only, and once more for the keys
    counts = texts.select(F.explode(of_text(F.col("text"))).alias("gram")).join(asked, "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    key = wanted.join(counts, "gram", "left").groupBy("pattern_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("k")).where("k.n > 0")
    held = written(key.select("pattern_id", F.col("k.gram").alias("gram")).join(patterns.select("pattern_id", "pattern"), "pattern_id"), "pattern-keys")
    if (keys := small(held)) is not held:  # patterns go to the texts
        pairs = texts.select("text_id", "text", F.explode(of_text(F.col("text"))).alias("gram")).join(keys, "gram")
    else:
        pairs = texts.select("text_id", F.explode(of_text(F.col("text"))).alias("gram")).join(held, "gram").drop("gram").join(texts, "text_id")
    found = pairs.where(F.contains("text", F.col("pattern"))).select("text_id", "pattern_id")
    bare = written(patterns.where(F.size("grams") == 0).select("pattern_id", "pattern"), "bare-patterns")
    if bare.limit(1).count():
        n = bare.count()
        if n > 1000:
            raise ValueError(f"{n} patterns have no gram; choose shorter grams")
        rest = texts.join(F.broadcast(bare), F.contains("text", F.col("pattern"))).select("text_id", "pattern_id")  # at most 1,000 rows
        found = found.unionByName(rest)
    return found


def audited(files: DataFrame, pages: DataFrame, prefix: str = "source-") -> DataFrame:
    """files (name, normalised) with ingested: a page's key is the prefix and the name, or, both being over three
    characters, name and key without prefix contain one another. pages: key."""
    core = F.replace("key", F.lit(prefix), F.lit(""))
    names = files.select("name").where("name IS NOT NULL").distinct()
    keys = pages.where("key IS NOT NULL").select("key", core.alias("core"))
    exact = names.join(keys.select(F.col("key").alias("_k")).distinct(), F.concat(F.lit(prefix), "name") == F.col("_k"), "left_semi")
    cores = keys.where(F.length("core") > 3).select("core").distinct()
    long = names.where(F.length("name") > 3)
    one = containing(long.select(F.col("name").alias("text_id"), F.col("name").alias("text")), cores.select(F.col("core").alias("pattern_id"), F.col("core").alias("pattern")), characters(4))
    two = containing(cores.select(F.col("core").alias("text_id"), F.col("core").alias("text")), long.select(F.col("name").alias("pattern_id"), F.col("name").alias("pattern")), characters(4))
    hit = exact.select("name").union(one.select("text_id")).union(two.select("pattern_id")).distinct().select(F.col("name").alias("_n"))
    return files.join(hit, F.col("name") == F.col("_n"), "left").withColumn("ingested", F.col("_n").isNotNull()).drop("_n")
