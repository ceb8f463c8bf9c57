"""From search hits to answers: bodies of hits, context and citations, neighbours of sections, sources of slugs."""

from __future__ import annotations

import hashlib
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed texts of an answer's footer.
FOOTER, NO_SOURCE, NOT_RESOLVED = "\n\n원본: ", "(없음 — 외부 근거 없음)", "(해석 실패 — registry 점검 필요)"
#: Order in which a page's folders are tried.
FOLDERS = ["entities", "concepts", "sources", "analyses"]


def bodies(hits: DataFrame, docs: DataFrame, contents: DataFrame) -> DataFrame:
    """hits (hash and more) with the active documents that have the content, and its text."""
    own = docs.where("active").select("collection", "path", "title", "hash")
    return hits.join(own, "hash").join(contents.select("hash", "doc"), "hash")


def body_of(docs: DataFrame, contents: DataFrame) -> DataFrame:
    """Every document with the text of its content, null where the content is missing: a scalar lookup by a unique key."""
    return docs.join(contents.select("hash", F.col("doc").alias("body")), "hash", "left")


def sidecar(path: Column) -> Column:
    """Path of the text beside a source: text files are their own."""
    return F.when(path.rlike(r"(?i)\.(md|txt)$"), path).otherwise(F.concat(path, F.lit(".md")))


def stem(path: Column) -> Column:
    """Base name without its last extension; a leading dot is no extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(.)\.[^.]*$", "$1")


def extension(path: Column) -> Column:
    """Last extension in lower case, empty without one."""
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r".\.([^.]+)$", 1))


def cited(answers: DataFrame, citations: DataFrame, registry: DataFrame, mode: str = "raw") -> DataFrame:
    """answer_id, answer with the links of its sources: citations (answer_id, pos, source_id), registry (source_id, path).

    Each target is linked once, at its first citation. An answer without citations and one none of which resolves get a
    footer that says so; mode: raw links sources, sidecar their texts, hidden none."""
    body = F.rtrim(F.col("answer"))
    if mode == "hidden":
        return answers.select("answer_id", body.alias("answer"))
    c = citations.join(registry.select("source_id", "path"), "source_id", "left")
    target = sidecar(F.col("path")) if mode == "sidecar" else F.col("path")
    c = c.select("answer_id", "pos", target.alias("target"), stem(F.col("path")).alias("shown"))
    first = c.groupBy("answer_id", "target").agg(F.min(F.struct("pos", "shown")).alias("f"))
    link = F.when(F.col("target").isNotNull(), F.struct("f.pos", F.format_string("[[%s|%s]]", F.col("target"), F.col("f.shown")).alias("link")))
    per = first.groupBy("answer_id").agg(F.sort_array(F.collect_list(link)).alias("l")).select("answer_id", F.array_join("l.link", ", ").alias("links"))
    foot = F.when(F.col("links").isNull(), NO_SOURCE).when(F.col("links") == "", NOT_RESOLVED).otherwise(F.col("links"))
    return answers.join(per, "answer_id", "left").select("answer_id", F.concat(body, F.lit(FOOTER), foot).alias("answer"))


def placed(pages: DataFrame) -> DataFrame:
    """base, path: of the pages of one base name the one whose folder comes first in FOLDERS."""
    rank = F.array_position(F.array(*[F.lit(x) for x in FOLDERS]), F.col("folder"))
    return pages.where(rank > 0).groupBy("base").agg(F.min_by("path", F.struct(rank, "path")).alias("path"))


def peers(sections: DataFrame, doc: str, order: str, title: str, most: int = 200) -> DataFrame:
    """sections with prev and next title in their document, and overview: all titles, cut to `most` characters."""
    w = W.partitionBy(doc).orderBy(order)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    text = F.substring(F.array_join(F.collect_list(title).over(whole), " > "), 1, most)
    return sections.withColumns({"prev": F.lag(title).over(w), "next": F.lead(title).over(w), "overview": text})


def repeaters(texts: DataFrame, doc: str, text: str, least: int = 3, most: int = 10, any_case: bool = False) -> DataFrame:
    """doc, token, n, rank: acronyms that a document's text has `least` times or more; the `most` most frequent. any_case:
    letters count as their capitals, one for one, so a token with a letter without one from A to Z (ß) is none."""
    small = "a-z\u0131\u017f" if any_case else ""  # the last two have the capitals I and S
    t = texts.select(doc, F.explode(F.split(text, r"[\s,.;:()\[\]{}]+")).alias("token")).where(F.col("token").rlike(rf"^[A-Z{small}][A-Z{small}0-9]{{1,5}}\z"))
    if any_case:
        t = t.withColumn("token", F.upper("token"))
    n = t.groupBy(doc, "token").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    rank = F.row_number().over(W.partitionBy(doc).orderBy(F.desc("n"), "token"))
    return n.withColumn("rank", rank).where(F.col("rank") <= most)


def slug_sources(mentions: DataFrame) -> DataFrame:
    """slug, sources (sorted, distinct), n_sources of mentions (slug, source)."""
    return mentions.groupBy("slug").agg(F.array_sort(F.collect_set("source")).alias("sources")).withColumn("n_sources", F.size("sources"))


def diverse(members: DataFrame, slugs: int = 3, sources: int = 2) -> DataFrame:
    """Clusters (cluster, slug, source) of at least so many distinct slugs and sources: cluster, n_slugs, n_sources."""
    g = members.groupBy("cluster").agg(F.count_distinct("slug").alias("n_slugs"), F.count_distinct("source").alias("n_sources"))
    return g.where((F.col("n_slugs") >= slugs) & (F.col("n_sources") >= sources))


def source_mentions(members: DataFrame) -> DataFrame:
    """cluster, source, slugs: which members of a cluster each source mentions."""
    return members.groupBy("cluster", "source").agg(F.array_sort(F.collect_set("slug")).alias("slugs"))


def scored_once(pairs: DataFrame, text: str, most: int, score) -> DataFrame:
    """pairs with a score of their text cut to `most` characters; equal texts are scored once and share it."""
    cut = F.substring(F.col(text), 1, most)
    once = pairs.select(cut.alias("_cut")).distinct().withColumn("score", score(F.col("_cut")))
    return pairs.withColumn("_cut", cut).join(once, "_cut").drop("_cut")


def bundle_ids(files: DataFrame) -> DataFrame:
    """bundle, bundle_id: SHA-256 of the lines path, tab, hash of a bundle's files in path order (bytes)."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("path", "hash"))), lambda x: F.concat(x.path, F.lit("\t"), x.hash))
    return files.groupBy("bundle").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("bundle_id"))


def convert_key(digest: Column, converter: str, options: dict) -> Column:
    """Cache key of a conversion: content, converter and options in the order of their names."""
    return F.sha2(F.concat_ws("|", digest, F.lit(converter), *[F.lit(f"{k}={options[k]}") for k in sorted(options)]), 256)


def normal_text_hash(text: Column) -> Column:
    """SHA-256 of the text in Unicode's composed form (Spark has no function for it)."""
    @F.pandas_udf("string")
    def digest(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else hashlib.sha256(unicodedata.normalize("NFC", t).encode()).hexdigest())

    return digest(text)


def open_uri(vault: str, path: Column) -> Column:
    return F.concat(F.lit(f"obsidian://open?vault={vault}&file="), F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")))


def file_uri(path: Column) -> Column:
    """file:// and the path, of which each part is encoded."""
    return F.concat(F.lit("file://"), F.array_join(F.transform(F.split(path, "/"), lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))), "/"))


def audit_name(name: Column) -> Column:
    """Runs of anything but letters, digits and Hangul as one hyphen, none at the ends, in lower case."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9가-힣]+", "-"), "^-+|-+$", "")


def is_wiki_path(path: Column) -> Column:
    return path.rlike(r"^(\./|/)*wiki(/|$)")


def image_counts(text: Column) -> tuple[Column, Column]:
    """Number of embedded (data URI) and of other images of Markdown."""
    inner = F.regexp_count(text, F.lit(r"!\[[^\]]*\]\(data:"))
    return inner, F.regexp_count(text, F.lit(r"!\[[^\]]*\]\([^)]+\)")) - inner


def body_chars(text: Column) -> Column:
    """Length of the text without images, marks of Markdown and runs of white space."""
    bare = F.regexp_replace(F.regexp_replace(text, r"!\[.*?\]\([^)]+\)", ""), r"\[image(?::[^\]]*)?\]", "")
    return F.length(F.trim(F.regexp_replace(F.regexp_replace(bare, r"[#>*`|\-]", ""), r"\s+", " ")))


def likely_scan(text: Column, pages: Column) -> Column:
    """Under 100 characters a page and under 50 Hangul ones in all, where the number of pages is known."""
    hangul = F.length(F.regexp_replace(text, "[^가-힣]+", ""))
    return (pages > 0) & (body_chars(text) / pages < 100) & (hangul < 50)


#: Of a line: an image's mark, or an item of a list.
IMAGE, ITEM = r"(?i)(<!--\s*image\s*-->)|(!\[[^\]]*\]\([^)]*\))|(\[image(?::[^\]]*)?\])", r"^\s*([-*+]\s|\d+\.\s)"


def ocr_polluted(text: Column) -> Column:
    """Whether a text of 2000 characters or more with five or more lines of image marks has three short lines in a row
    within five lines of a mark (blank lines do not count, marks and items end a row), or more short lines than others."""
    lines = F.split(text, "\n")
    # w: wanted short line, x: blank, o: any other, i: mark
    kind = lambda s: F.when(s.rlike(IMAGE), "i").when(F.trim(s) == "", "x").when((F.length(F.trim(s)) < 20) & ~s.rlike(ITEM), "w").otherwise("o")

    def judged(code):
        at = F.filter(F.sequence(F.lit(1), F.length(code)), lambda k: F.substring(code, k, F.lit(1)) == "i")
        windows = F.transform(at, lambda k: F.array(F.substring(code, F.greatest(k - 5, F.lit(1)), k - F.greatest(k - 5, F.lit(1))), F.substring(code, k + 1, F.lit(5))))
        near = F.exists(F.flatten(windows), lambda s: s.rlike("wx*wx*w"))
        share = F.regexp_count(code, F.lit("w")) / F.greatest(F.regexp_count(code, F.lit("[^x]")), F.lit(1))
        return (F.regexp_count(code, F.lit("i")) >= 5) & (near | (share > 0.5))

    # the code is an element of an array, as a plain column would be made anew for each of its lines
    code = F.array(F.array_join(F.transform(lines, kind), ""))
    return (F.length(F.trim(text)) >= 2000) & F.get(F.transform(code, judged), 0)


def fetch_size(limit: int, everything: bool = False) -> int:
    """Rows that a search asks for before it filters."""
    return 100_000 if everything else max(50, 2 * limit)


def first_seen_split(rows: DataFrame, key: Column, order: str, tenths: int = 9) -> DataFrame:
    """The first row of each key, with part: train for `tenths` of ten hash buckets of the key, else test."""
    one = rows.withColumn("_k", key).groupBy("_k").agg(F.min_by(F.struct(*rows.columns), order).alias("r"))
    bucket = F.conv(F.substring(F.md5("_k"), 1, 7), 16, 10).cast("long") % 10
    return one.select("r.*", F.when(bucket < tenths, "train").otherwise("test").alias("part"))
