"""Scalar functions over text, paths, hashes and numbers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no intent (fixed values).
INTENT_STOP_WORDS = (
    "am an as at be by do he if in is it me my no of on or so to up us we all and any are but can did for get has her him his how its let may not our out the too was who why you "
    "also does find from have into more need show some tell that them this want what when will with your about looking notes search where which"
).split()
HANGUL = "[\\uAC00-\\uD7AF]"


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def file_id(data: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(data, 256), 1, 16))


def uri_id(uri: Column) -> Column:
    return F.concat(F.lit("uri-hash:"), F.substring(F.sha2(uri, 256), 1, 16))


def cache_key(url: Column, body: Column) -> Column:
    return F.sha2(F.concat(url, F.to_json(body)), 256)


def bm25_unit(raw: Column) -> Column:
    return F.abs(raw) / (1 + F.abs(raw))


def bm25_sigmoid(raw: Column) -> Column:
    return 1 / (1 + F.exp(-(F.abs(raw) - 5) / 3))


def title(body: Column, path: Column) -> Column:
    """First heading of level 1 or 2 (the one after it, if it is 'Notes'), else the file's stem."""
    heads = F.filter(F.regexp_extract_all(body, F.lit(r"(?m)^##?[ \t]+(.+)$"), F.lit(1)), lambda h: F.trim(h) != "Notes")
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]+$", "")
    return F.coalesce(F.trim(F.get(heads, 0)), stem)


def first_sentence(body: Column) -> Column:
    """Text without front matter and first heading: up to the first terminator within 5 to 160 characters, else the
    first 100 characters."""
    t = F.regexp_replace(body, r"^---\n[\s\S]*?\n---\n?", "")
    t = F.trim(F.regexp_replace(t, r"^\s*#[^\n]*\n", ""))
    s = F.regexp_extract(t, r"^([^.!?\n]{4,159}[.!?])", 1)
    return F.when(s != "", s).otherwise(F.substring(t, 1, 100))


def front_matter(text: Column) -> Column:
    """Map of the key: value lines of a leading front matter; an empty map without one."""
    block = F.regexp_extract(text, r"^---\n([\s\S]*?)\n---", 1)
    keys = F.regexp_extract_all(block, F.lit(r"(?m)^([A-Za-z_][A-Za-z0-9_-]*):[ \t]*(.*)$"), F.lit(1))
    vals = F.regexp_extract_all(block, F.lit(r"(?m)^([A-Za-z_][A-Za-z0-9_-]*):[ \t]*(.*)$"), F.lit(2))
    first = F.filter(F.arrays_zip(keys.alias("k"), vals.alias("v")), lambda x, i: F.array_position(keys, x["k"]) == i + 1)
    return F.map_from_entries(first)


def strip_images(text: Column) -> Column:
    t = F.regexp_replace(text, r"!\[([^\]]*)\]\(data:[^)]*\)", "[image]")
    t = F.regexp_replace(t, r"!\[\]\(https?://[^)]*\)", "[image]")
    return F.regexp_replace(t, r"!\[([^\]]+)\]\(https?://[^)]*\)", "[image: $1]")


def strip_tags(html: Column) -> Column:
    """Text of HTML without scripts, styles, comments and tags; white space squeezed."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"<[^>]*>", " "), r"\s+", " "))


def json_block(text: Column) -> Column:
    """The fenced JSON of a model's answer, else from the first { to the last }; null if it does not parse."""
    fence = F.regexp_extract(text, r"```(?:json)?\s*([\s\S]*?)```", 1)
    bare = F.regexp_extract(text, r"(\{[\s\S]*\})", 1)
    got = F.when(fence != "", F.regexp_replace(fence, r"^\s+|\s+$", "")).when(bare != "", bare)
    return F.when(F.try_parse_json(got).isNotNull(), got)


def intent_terms(text: Column) -> Column:
    words = F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(INTENT_STOP_WORDS))


def highlight(text: Column, terms: list[str]) -> Column:
    for t in terms:
        if len(t) >= 3:
            text = F.regexp_replace(text, "(?i)(" + "".join(c if c.isalnum() else "\\" + c for c in t) + ")", "<b>$1</b>")
    return text


def escape_xml(t: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def escape_csv(t: Column) -> Column:
    return F.when(t.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def language_hint(text: Column) -> Column:
    """ko, en or mixed by the share of Hangul among characters that are no white space; en for an empty text."""
    n, all_ = F.regexp_count(text, F.lit(HANGUL)), F.regexp_count(text, F.lit(r"\S"))
    share = F.when(all_ > 0, n / all_).otherwise(0.0)
    return F.when(share > 0.6, "ko").when(share < 0.2, "en").otherwise("mixed")


def tokens_estimate(text: Column) -> Column:
    """ceil(length / divisor * 1.3); the divisor falls with the share of Hangul."""
    share = F.when(F.length(text) > 0, F.regexp_count(text, F.lit(HANGUL)) / F.length(text)).otherwise(0.0)
    return F.ceil(F.length(text) / F.when(share > 0.5, 1.5).when(share > 0.2, 2.5).otherwise(4.0) * 1.3)


def route(tokens: Column, context: int, reserve: float = 0.2, overhead: int = 2000, whole: bool = False) -> Column:
    """FULL where the tokens fit what the context has without its reserve and the overhead, else SEGMENTED. whole: the
    context without its reserve is rounded to whole tokens first."""
    usable = context * (1 - reserve)
    return F.when(tokens <= (round(usable) if whole else usable) - overhead, "FULL").otherwise("SEGMENTED")


def truncate(text: Column, most: int = 12_000, marker: str = "\n[...]\n") -> Column:
    """Keeps 70 % of `most` characters from the start and 25 % from the end of a longer text."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, int(most * 0.7)), F.lit(marker), F.right(text, F.lit(int(most * 0.25)))))


def acronym_share(text: Column) -> Column:
    t = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.when(F.size(t) > 0, F.size(F.filter(t, lambda w: w.rlike("^[A-Z][A-Z0-9]{1,5}$"))) / F.size(t)).otherwise(0.0)


def long_token_share(text: Column, least: int = 15) -> Column:
    t = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.when(F.size(t) > 0, F.size(F.filter(t, lambda w: F.length(w) >= least)) / F.size(t)).otherwise(0.0)


def quality_score(text: Column) -> Column:
    """1 less 0.3 for broken table rows, 0.3 for empty headings, 0.4 for long tokens and 0.4 for image marks (each by its
    share, at most whole), not below 0; texts under 100 characters have 0."""
    l = F.split(text, "\n", -1)
    share = lambda a, b: F.when(b > 0, F.least(a / b, F.lit(1.0))).otherwise(0.0)
    tables = F.size(F.filter(l, lambda x: F.contains(x, F.lit("|"))))
    broken = F.size(F.filter(l, lambda x: F.contains(x, F.lit("|")) & (F.regexp_count(x, F.lit(r"\|")) < 2)))
    heads = F.regexp_count(text, F.lit(r"(?m)^#{1,6} "))
    empty = F.regexp_count(text, F.lit(r"(?m)^#{1,6} [^\n]*\n(?:[ \t]*\n)*(?=#{1,6} )"))
    marks = F.regexp_count(text, F.lit(r"!\[[^\]]*\]\("))
    s = 1 - 0.3 * share(broken, tables) - 0.3 * share(empty, heads) - 0.4 * (long_token_share(text) > 0.3).cast("double") - 0.4 * share(marks, F.size(l))
    return F.when(F.length(text) < 100, 0.0).otherwise(F.greatest(s, F.lit(0.0)))


def regression(base: Column, new: Column, least: int, keep: float = 0.5) -> Column:
    """Whether a new conversion lost too much of a base of at least `least` characters."""
    return (base >= least) & (new < keep * base)


def classify(name: Column, classes: dict[str, list[str]], default: str = "000") -> Column:
    """The first class one of whose words is a whole word of the name."""
    words = F.split(F.lower(name), r"[^\p{L}\p{N}]+")
    out = None
    for c, ws in classes.items():
        hit = F.arrays_overlap(words, F.array(*[F.lit(w) for w in ws]))
        out = F.when(hit, c) if out is None else out.when(hit, c)
    return F.lit(default) if out is None else out.otherwise(default)


def query_category(q: Column) -> Column:
    """Kind of a search query; the first rule that fits."""
    low, n = F.lower(F.trim(q)), F.size(F.split(F.trim(q), r"\s+"))
    return F.when(low.rlike(r"^(how|howto)\b"), "how-to").when(low.rlike(r"^(what|who|when|where|which|why)\b"), "question").when(low.rlike(r"\b(vs|versus|compare|difference)\b"), "comparison").when(low.rlike(r"\b(error|exception|fail|bug|fix)\b"), "troubleshooting").when(q.rlike(r"[A-Za-z]+[._/][A-Za-z]+"), "code").when(n <= 2, "keyword").when(n >= 12, "passage").otherwise("topic")


def time_ago(seconds: Column) -> Column:
    return F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s ago"))).when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m ago"))).when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h ago"))).otherwise(F.concat(F.floor(seconds / 86400).cast("string"), F.lit("d ago")))


def bytes_text(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, F.format_string("%.1f KB", n / 1024)).when(n < 1024**3, F.format_string("%.1f MB", n / 1024**2)).otherwise(F.format_string("%.1f GB", n / 1024**3))
