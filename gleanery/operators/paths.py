"""Finding documents by path: globs, suffixes, short ids, fuzzy names, single and multi get, path contexts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEME = "note://"


def virtual(collection: Column, path: Column) -> Column:
    return F.concat(F.lit(SCHEME), collection, F.lit("/"), path)


def glob_regex(pattern: str) -> str:
    """A regular expression for a glob: ** crosses folders, * and ? do not, {a,b} are alternatives, [..] a class."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body) + "]", end
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def matches_glob(pattern: str) -> Column:
    """The pattern fits the virtual path, the path, or collection/path."""
    rx = glob_regex(pattern)
    return virtual(F.col("collection"), F.col("path")).rlike(rx) | F.col("path").rlike(rx) | F.concat("collection", F.lit("/"), "path").rlike(rx)


def ends_with(name: str) -> Column:
    """The path ends with name, letters of either case."""
    return F.lower(F.col("path")).endswith(name.lower())


def short_id(hash_: Column) -> Column:
    return F.substring(hash_, 1, 6)


def clean_id(text: str) -> str:
    """A short id without white space, enclosing quotes and the leading #."""
    t = text.strip()
    if len(t) > 1 and t[0] == t[-1] and t[0] in "\"'":
        t = t[1:-1]
    return t[1:] if t.startswith("#") else t


def is_short_id(text: str) -> bool:
    return bool(re.fullmatch(r"[0-9a-fA-F]{6,}", clean_id(text)))


def by_short_id(docs: DataFrame, text: str) -> DataFrame:
    """The first active document (by collection, path) the hash of which begins with the id."""
    return docs.where("active").where(F.col("hash").startswith(clean_id(text).lower())).orderBy("collection", "path").limit(1)


def similar(docs: DataFrame, name: str, most: int = 3, k: int = 5) -> DataFrame:
    """path, distance of the k paths nearest to name by edit distance, at most `most` away."""
    d = F.levenshtein(F.lower(F.col("path")), F.lit(name.lower()), most)
    return docs.where("active").select("path", d.alias("distance")).where("distance >= 0").orderBy("distance", "path").limit(k)


def get(docs: DataFrame, name: str) -> DataFrame:
    """The document that name means: a line suffix is cut off; then a short id (and nothing else, if it looks like one);
    else an exact virtual path, collection/path, path, or the end of a path, in this order."""
    name = re.sub(r":\d+(?:-\d+)?$", "", name.strip())
    if is_short_id(name):
        return by_short_id(docs, name).withColumn("how", F.lit("id"))
    how = F.when(virtual(F.col("collection"), F.col("path")) == name, 0).when(F.concat("collection", F.lit("/"), "path") == name, 1).when(F.col("path") == name, 2).when(ends_with(name), 3)
    names = F.element_at(F.array(F.lit("virtual"), F.lit("collection"), F.lit("path"), F.lit("suffix")), F.col("_how") + 1)
    return docs.where("active").withColumn("_how", how).where("_how IS NOT NULL").orderBy("_how", "collection", "path").limit(1).withColumn("how", names).drop("_how")


def multi_get(docs: DataFrame, names: DataFrame, max_bytes: int) -> DataFrame:
    """name, path, n_bytes, skipped of each wanted name (one column): the exact path, else the first path that ends so;
    path is null for no match, skipped gives the reason for a document that is too large."""
    live = docs.where("active").select("path", F.octet_length("doc").alias("n_bytes"))
    n = F.broadcast(names)  # what a caller asks for at once
    hits = live.join(n, (F.col("path") == F.col("name")) | F.col("path").endswith(F.concat(F.lit("/"), F.col("name"))))
    hits = hits.groupBy("name").agg(F.min(F.struct((F.col("path") != F.col("name")).alias("_o"), "path", "n_bytes")).alias("h"))
    out = names.join(hits, "name", "left").select("name", "h.path", "h.n_bytes")
    why = F.when(F.col("n_bytes") > max_bytes, F.format_string("%d KB", F.ceil(F.col("n_bytes") / 1024).cast("int")))
    return out.withColumn("skipped", why)


def contexts(docs: DataFrame, ctx: DataFrame) -> DataFrame:
    """collection, path, context: all contexts of prefixes of the path, general to specific, joined by a blank line. A
    prefix need not end at a folder. ctx: collection, prefix, context; Spark broadcasts it if
    it is small."""
    c = ctx.withColumnRenamed("collection", "_c")
    j = docs.select("collection", "path").join(c, (F.col("collection") == F.col("_c")) & F.col("path").startswith(F.col("prefix")), "left")
    parts = F.array_sort(F.collect_list(F.when(F.col("prefix").isNotNull(), F.struct(F.length("prefix").alias("n"), "prefix", "context"))))
    g = j.groupBy("collection", "path").agg(parts.alias("p"))
    return g.select("collection", "path", F.when(F.size("p") > 0, F.array_join(F.col("p.context"), "\n\n")).alias("context"))


def longest_context(docs: DataFrame, ctx: DataFrame, default: str | None = None) -> DataFrame:
    """collection, path, context: the context of the longest prefix, else the default."""
    c = ctx.withColumnRenamed("collection", "_c")
    j = docs.select("collection", "path").join(c, (F.col("collection") == F.col("_c")) & F.col("path").startswith(F.col("prefix")), "left")
    g = j.groupBy("collection", "path").agg(F.max_by("context", F.length("prefix")).alias("context"))
    return g.select("collection", "path", F.coalesce("context", F.lit(default)).alias("context"))


def without_context(docs: DataFrame, ctx: DataFrame) -> DataFrame:
    """collection, folder: top-level folders none of whose prefixes has a context."""
    top = docs.where("active").where(F.contains("path", F.lit("/"))).select("collection", F.substring_index("path", "/", 1).alias("folder")).distinct()
    return top.join(ctx.select("collection", F.rtrim(F.col("prefix"), F.lit("/")).alias("folder")), ["collection", "folder"], "left_anti")


def paired_sidecars(paths: DataFrame, convertible: list[str]) -> DataFrame:
    """path, hidden: x.pdf.md is hidden where x.pdf is there and its extension can be converted."""
    base = F.when(F.col("path").endswith(".md"), F.expr("substring(path, 1, length(path) - 3)"))
    src = paths.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(convertible)).select(F.col("path").alias("_p"))
    return paths.withColumn("_b", base).join(src, F.col("_b") == F.col("_p"), "left").select("path", F.col("_p").isNotNull().alias("hidden"))


def lines(text: Column, first: int, most: int) -> Column:
    """Lines `first` (from 1) to first + most - 1."""
    return F.array_join(F.slice(F.split(text, "\n", -1), first, most), "\n")


def numbered(text: Column, first: int = 1) -> Column:
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda l, i: F.concat((i + first).cast("string"), F.lit(": "), l)), "\n")
