"""Which of several conversions of a document to keep: quality, retries and their guards, and later tiers in order.

All of it is expressions over one row that holds a document's attempts, so it costs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.answers import body_chars, likely_scan, ocr_polluted

# Thresholds of the quality rules.
LEAST_BODY, LEAST_SCORE, LEAST_HANGUL, LONG_TOKEN, LONG_SHARE = 100, 0.6, 100, 15, 0.30
ACCEPTED, OCR_ACCEPTED = 50, 50
IMAGES = r"!\[.*?\]\([^)]+\)|\[image(?::[^\]]*)?\]"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def hangul(text: Column) -> Column:
    """Number of Hangul syllables outside image marks."""
    return F.length(F.regexp_replace(F.regexp_replace(text, IMAGES, ""), "[^가-힯]+", ""))


def spacing_lost(text: Column) -> Column:
    """A text with 100 Hangul syllables or more, over 30 % of whose Hangul tokens have 15 characters or more."""
    tokens = F.filter(F.split(F.regexp_replace(text, IMAGES, ""), r"\s+"), lambda t: t.rlike("[가-힯]"))
    long = F.size(F.filter(tokens, lambda t: F.length(t) >= LONG_TOKEN))
    return (hangul(text) >= LEAST_HANGUL) & (long / F.greatest(F.size(tokens), F.lit(1)) > LONG_SHARE)


def broken_tables(text: Column) -> Column:
    """Of the lines with three bars or more, the share with hardly anything else."""
    rows = F.filter(F.split(text, "\n"), lambda l: l.rlike(r"\|.*\|.*\|"))
    bare = F.filter(rows, lambda l: F.length(F.regexp_replace(l, r"[|\s]+", "")) < 3)
    return F.when(F.size(rows) > 0, F.size(bare) / F.size(rows)).otherwise(0.0)


def empty_sections(text: Column) -> Column:
    """Of the headings, the share with under 50 characters before the next one."""
    bodies = F.split(text, r"(?md)^#{1,6}[\t\x0B\f\r ].*$", -1)
    bodies = F.slice(bodies, 2, F.greatest(F.size(bodies) - 1, F.lit(0)))
    empty = F.filter(bodies, lambda b: F.length(trimmed(b)) < 50)
    return F.when(F.size(bodies) > 0, F.size(empty) / F.size(bodies)).otherwise(0.0)


def quality(text: Column) -> Column:
    """score, decision of a conversion: retry where word spacing was lost, retry-no-ocr where recognised scraps of images
    stand in the text, accept from a score of 0.6, else reject; under 100 characters reject with a score of 0."""
    short = F.length(trimmed(text)) < LEAST_BODY

    def judged(x):
        score = x.left - F.when(x.lost, 0.4).otherwise(0.0) - F.when(x.polluted, 0.4).otherwise(0.0)
        score = F.greatest(score, F.lit(0.0))
        decision = F.when(x.short, "reject").when(x.lost, "retry").when(x.polluted, "retry-no-ocr").when(score >= LEAST_SCORE, "accept").otherwise("reject")
        return F.struct(F.when(x.short, 0.0).otherwise(score).alias("score"), decision.alias("decision"))

    # each part is found once, as an element of an array
    parts = F.struct(short.alias("short"), spacing_lost(text).alias("lost"), ocr_polluted(text).alias("polluted"), (1.0 - 0.3 * broken_tables(text) - 0.3 * empty_sections(text)).alias("left"))
    return F.get(F.transform(F.array(parts), judged), 0)


def accepted(text: Column, least: int = ACCEPTED) -> Column:
    """The trimmed text if it has more than `least` characters, else null."""
    return F.when(F.length(trimmed(text)) > least, trimmed(text))


def regressed(base: Column, new: Column) -> Column:
    """Whether a retry lost half of the Hangul (of 100 or more) or half of the body (of 500 characters or more)."""
    half = lambda f, least: (f(base) >= least) & (f(new) < 0.5 * f(base))
    return half(hangul, 100) | half(body_chars, 500)


def chosen(attempts: DataFrame) -> DataFrame:
    """attempts with tier and converted: the attempt that is kept and its text (null where none is).

    attempts: base, no_ocr, force_ocr (texts, null for an attempt that failed), later (array of struct tier, text, in
    order), pages, image_share (of the source's pages that images cover), name, layer_chars, layer_hangul (of the source's
    own text). A scan is a base text with hardly anything on its pages, a source covered by images over half, or a Korean
    name over a text layer without Korean. Tiers: 1, 1-scan (base kept although it is a scan), 1a, 1b-scan, 1b-spacing, or
    the name of a later one. A retry that is worse, fails or lost half of the text is rolled back; one too short to accept,
    or no better than a bad base, goes on to the later tiers."""
    base, no_ocr, force = accepted(F.col("base")), accepted(F.col("no_ocr")), accepted(F.col("force_ocr"))
    row = attempts.withColumns({"_b": base, "_n": no_ocr, "_f": force})
    b, n, f = F.col("_b"), F.col("_n"), F.col("_f")
    corrupt = F.col("name").rlike("[가-힣]") & (F.col("layer_chars") > 500) & (F.col("layer_hangul") < 50)
    scan = likely_scan(b, F.col("pages")) | (F.col("image_share") > 0.5) | corrupt
    row = row.withColumns({"_q": F.when(b.isNotNull(), quality(b)), "_qn": F.when(n.isNotNull(), quality(n)), "_qf": F.when(f.isNotNull(), quality(f)), "_scan": F.coalesce(scan, F.lit(False))})
    ask, is_scan = F.col("_q.decision"), F.col("_scan")
    back = F.when(is_scan, "1-scan").otherwise("1")
    again = F.when(F.col("force_ocr").isNull(), back).when(f.isNull(), "later").when(regressed(b, f), back).when(F.col("_qf.decision") == "accept", F.when(is_scan, "1b-scan").otherwise("1b-spacing")).when(F.col("_q.score") > F.col("_qf.score"), back).otherwise("later")
    way = (
        F.when(b.isNull(), "later")
        .when((ask == "accept") & ~is_scan, "1")
        .when(ask == "retry-no-ocr", F.when(F.col("_qn.score") > F.col("_q.score"), "1a").otherwise("1"))
        .when((ask == "retry") | is_scan, again)
        .otherwise("later")
    )
    rest = F.filter(F.coalesce("later", F.array().cast(attempts.schema["later"].dataType)), lambda x: F.length(trimmed(x.text)) > OCR_ACCEPTED)
    row = row.withColumns({"_way": way, "_rest": F.get(rest, 0)})
    way = F.col("_way")
    tier = F.when(way != "later", way).otherwise(F.col("_rest.tier"))
    text = F.when(way.isin("1", "1-scan"), b).when(way == "1a", n).when(way.startswith("1b"), f).otherwise(trimmed(F.col("_rest.text")))
    return row.select(*attempts.columns, tier.alias("tier"), text.alias("converted"))


def images_redundant(raw: Column, stripped: Column, pages: Column, tier: Column) -> Column:
    """Whether embedded images only repeat the text: they are there, and the document is a scan."""
    return (F.length(raw) > F.length(stripped)) & (likely_scan(stripped, pages) | tier.isin("1b-scan", "1-scan"))
