"""What a model is given to read: pages of hits and their neighbours, sections of a source, and prefixes of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.operators.answers import FOLDERS

#: A link of a page: what follows | or # is not its target.
LINK = r"\[\[([^\]|#]+)"
#: Neighbours that are added to the pages of hits.
NEIGHBOURS = 5


def packed_pages(hits: DataFrame, pages: DataFrame, neighbours: int = NEIGHBOURS, most: int | None = None) -> DataFrame:
    """query_id, place (from 1), path, how (hit or link), content: hits (query_id, rank, path) that are pages (path, content),
    in rank order, then pages that they link to.

    A link is a base name, counted once for each page that has it; names of most pages come first, then those seen first. A
    name is the page of its first folder in FOLDERS; names without a page and pages that are hits are passed over before
    `neighbours` are taken. most: characters of content in all; a page that would go over it is left out, and smaller ones
    after it may still come in, but the first hit always stays, cut to that length. A path of several hits counts once,
    at its first rank. Hits of a query are a result list, so a query's pages are one group; other groups are no larger."""
    base = hits.groupBy("query_id", "path").agg(F.min("rank").alias("rank")).join(pages.select("path", "content"), "path")
    names = F.array_distinct(F.transform(F.regexp_extract_all("content", F.lit(LINK), F.lit(1)), lambda t: F.element_at(F.split(F.trim(t), "/"), -1)))
    seen = base.select("query_id", "rank", F.posexplode(names).alias("pos", "name")).where("name <> ''")
    links = seen.groupBy("query_id", "name").agg(F.count("*").alias("n"), F.min(F.struct("rank", "pos")).alias("first"))
    parts = F.split("path", "/")
    folder = F.array_position(F.array(*[F.lit(f) for f in FOLDERS]), F.element_at(parts, -2))
    named = pages.where(F.size(parts) >= 2).select(F.regexp_replace(F.element_at(parts, -1), r"\.md$", "").alias("name"), folder.alias("folder"), "path").where("folder > 0")
    named = named.groupBy("name").agg(F.min(F.struct("folder", "path")).getField("path").alias("path"))
    found = links.join(named, "name").join(base.select("query_id", "path"), ["query_id", "path"], "left_anti")
    order = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("n"), "first", "name"))
    found = found.withColumn("rank", order).where(F.col("rank") <= neighbours).join(pages.select("path", "content"), "path")
    both = base.select("query_id", "rank", "path", F.lit("hit").alias("how"), "content").unionByName(found.select("query_id", "rank", "path", F.lit("link").alias("how"), "content"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("how", "rank", "path"))
    both = both.select("query_id", place.alias("place"), "path", "how", "content")
    return both if most is None else _fitted(both, most)


def _fitted(pages: DataFrame, most: int) -> DataFrame:
    """Pages that fit a length, greedily in their order: one pass over a query's list of lengths."""
    size = F.when(F.col("place") == 1, F.least(F.length("content"), F.lit(most))).otherwise(F.length("content"))
    listed = pages.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", size.alias("size")))).alias("l"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"))
    step = lambda s, x: F.when(s.used + x["size"] <= most, F.struct((s.used + x["size"]).alias("used"), F.concat(s.kept, F.array(x.place)).alias("kept"))).otherwise(s)
    kept = listed.select("query_id", F.explode(F.aggregate("l", start, step).getField("kept")).alias("place"))
    fit = pages.join(kept, ["query_id", "place"])
    order = F.row_number().over(W.partitionBy("query_id").orderBy("place"))
    return fit.select("query_id", order.alias("place"), "path", "how", F.when(F.col("place") == 1, F.left("content", F.lit(most))).otherwise(F.col("content")).alias("content"))


def context(packed: DataFrame) -> DataFrame:
    """query_id, context: the pages of a query under their file names, in order."""
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    block = F.concat(F.lit("--- "), name, F.lit(".md ---\n"), F.coalesce("content", F.lit("")), F.lit("\n"))
    per = packed.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", block.alias("block")))).alias("l"))
    return per.select("query_id", F.array_join("l.block", "\n").alias("context"))


def targeted(sections: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Sections (with priority) that are read closely: core and support ones; all of a document that has neither."""
    wanted = F.col("priority").isin("core", "support")
    have = sections.where(wanted).select(doc).distinct().withColumn("_have", F.lit(True))
    return sections.join(have, doc, "left").where(wanted | F.col("_have").isNull()).drop("_have")


def prefixed(texts: DataFrame, prefixes: DataFrame, text: str = "text") -> DataFrame:
    """texts (hash, text) with the prefix of their content, if it has one, in front, and a blank line between."""
    p = prefixes.where("prefix IS NOT NULL").groupBy("hash").agg(F.min("prefix").alias("_prefix"))
    body = F.when(F.col("_prefix").isNull(), F.col(text)).otherwise(F.concat("_prefix", F.lit("\n\n"), F.col(text)))
    return texts.join(p, "hash", "left").withColumn(text, body).drop("_prefix")


def peers(sections: DataFrame, repeaters: DataFrame, most: int = 300, doc: str = "doc_id") -> DataFrame:
    """doc, idx, peer: what is said of a section's surroundings. sections: doc, idx, title, chars, priority, has_table,
    acronyms (share); repeaters: doc, token, n, rank. The overview and the repeaters are made once for each document and
    joined to its sections."""
    cut = min(200, most // 2)
    titles = sections.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("idx", "title"))).alias("l")).select(doc, F.left(F.array_join("l.title", ", "), F.lit(cut)).alias("_all"))
    tokens = repeaters.where(F.col("rank") <= 10).groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("rank", F.format_string("%s(%d)", "token", "n").alias("t")))).alias("l")).select(doc, F.array_join("l.t", ", ").alias("_often"))
    w = W.partitionBy(doc).orderBy("idx")
    line = F.concat(F.lit(" §"), F.col("idx").cast("string"), F.lit(" "), "title", F.lit(" | "), "priority", F.lit(" | chars: "), F.col("chars").cast("string"))
    near = lambda k, name: F.concat(F.lit(f"- {name}"), F.coalesce(F.lag(line, k).over(w), F.lit(": (없음)")))
    rows = sections.withColumns({"_prev": near(1, "prev"), "_next": near(-1, "next")}).join(titles, doc).join(tokens, doc, "left")
    own = F.concat_ws("\n", F.concat(F.lit("- idx: "), F.col("idx").cast("string")), F.concat(F.lit("- title: "), "title"), F.concat(F.lit("- priority: "), "priority", F.lit(" (heuristic)")), F.concat(F.lit("- hasTable: "), F.col("has_table").cast("string"), F.lit(", acronymDensity: "), F.format_string("%.3f", "acronyms")))
    peer = F.concat_ws("\n", F.concat(F.lit("DOC_OVERVIEW: "), "_all"), F.concat(F.lit("GLOBAL_REPEATERS: "), F.coalesce("_often", F.lit(""))), F.lit(""), F.lit("CURRENT_SECTION:"), own, F.lit(""), F.lit("LOCAL_NEIGHBORS:"), "_prev", "_next")
    return rows.select(doc, "idx", peer.alias("peer"))
