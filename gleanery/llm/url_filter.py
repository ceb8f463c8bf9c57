"""URL filter: a blocked Bloom filter of listed canonical URLs, an exact join behind it, and host/path rules.

The filter is a table of at most `max_blocks` rows of four 64-bit words. Its size is bounded by that parameter and
not by the list, so it may be broadcast; a long list only lets more URLs through to the exact join, which removes
every false positive. URLs that the filter rules out are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (action, host, path) of the rules; the longest that fits wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SALTS = 16


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds _host, _path: both empty for null or without '://'. Host: up to / ? # or the end, A-Z lower-cased."""
    at = F.locate("://", F.col(url))
    df = df.withColumn("_rest", F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise(F.lit("")))
    df = df.withColumn("_rest", F.coalesce("_rest", F.lit("")))
    df = df.withColumn("_raw", F.regexp_extract("_rest", "^([^/?#]*)", 1))
    tail = F.substring(F.col("_rest"), F.length("_raw") + 1, F.length("_rest"))
    return df.select("*", F.translate("_raw", UPPER, LOWER).alias("_host"), F.regexp_extract(tail, "^([^?#]*)", 1).alias("_path")).drop("_rest", "_raw")


def canonical(host: Column, path: Column) -> Column:
    """Host without port and a leading www. or m., and path without final .html and slashes; scheme, query and
    fragment do not count. Empty for a URL without host."""
    bare = F.regexp_replace(F.regexp_replace(host, ":[0-9]*$", ""), "^(www|m)[.]", "")
    return F.when(host == "", F.lit("")).otherwise(F.concat(bare, F.regexp_replace(F.regexp_replace(path, "[.]html$", ""), "/+$", "")))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as 'host' + path and its action; null without one. Ties go to the rule listed first."""
    name = action = None
    for what, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        action = F.when(fits, what) if action is None else action.when(fits, what)
    return name, action


def _bits(h: Column) -> list[Column]:
    """Two bits in each of the four words of a block, from disjoint parts of a 64-bit hash."""
    bit = lambda shift: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63)).cast("int"))
    return [bit(16 + 12 * i).bitwiseOR(bit(22 + 12 * i)) for i in range(4)]


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(h, F.lit(11)), F.lit(blocks)).cast("int")


def bloom(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, w0..w3): the OR of the bits of all keys of a block; at most `blocks` rows."""
    h = F.xxhash64(key)
    words = _bits(h)
    rows = listed.select(_block(h, blocks).alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(words)])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)])


def judge(pages: DataFrame, listed: DataFrame, url: str = "url", rules=RULES, max_blocks: int = 1 << 16) -> DataFrame:
    """Adds host, path, listed (boolean), rule, verdict to each row of pages; listed has one column of canonical URLs.

    Verdict: the rule's action; without a rule, block for a listed canonical URL and allow for others. Null or
    malformed URLs have empty host and path, are never listed, and are allowed. Repeated rows stay, every one is
    judged. Null or empty entries of the list are ignored, an empty list blocks nothing. Other columns stay.
    """
    taken = {"host", "path", "listed", "rule", "verdict"}  # of the input, these are kept under another name
    row = [F.col(f"_row.`{c}`").alias(f"{c}_input" if c in taken else c) for c in pages.columns]
    listed = listed.select(F.col(f"`{listed.columns[0]}`").alias("_key")).where(F.col("_key") != "").distinct()
    salt = F.pmod(F.xxhash64(url, *[c for c in pages.columns if c.endswith("_id")][:1]), F.lit(SALTS)).cast("int")
    p = with_parts(pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_row"), F.col(url).alias("_url"), salt.alias("_salt")), "_url")
    p = p.withColumn("_canon", canonical(F.col("_host"), F.col("_path")))
    h = F.xxhash64("_canon")
    filt = bloom(listed, "_key", max_blocks)
    p = p.withColumn("_b", _block(h, max_blocks)).join(F.broadcast(filt), F.col("_b") == F.col("block"), "left")
    hit = F.lit(True)
    for i, w in enumerate(_bits(h)):
        hit = hit & (F.col(f"w{i}").bitwiseAND(w) == w)
    p = p.withColumn("_hit", F.coalesce(hit & (F.col("_canon") != ""), F.lit(False))).drop("_b", "block", "w0", "w1", "w2", "w3")
    out = p.where(~F.col("_hit")).withColumn("_listed", F.lit(False))
    salted = listed.select("_key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    sure = p.where("_hit").join(salted, (F.col("_canon") == F.col("_key")) & (F.col("_salt") == F.col("_s")), "left")
    sure = sure.withColumn("_listed", F.col("_key").isNotNull()).drop("_key", "_s")
    name, action = rule_of(F.col("_host"), F.col("_path"), rules)
    method = F.when(F.col("_listed"), "block").otherwise("allow")
    return out.unionByName(sure).select(*row, F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_listed").alias("listed"), name.alias("rule"), F.coalesce(action, method).alias("verdict"))
