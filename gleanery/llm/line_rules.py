"""Quality rules, line first: rules of punctuation, navigation and boilerplate judge each line; lines that fail go, and a
document that loses too much of its text this way is rejected.

All of it is expressions over one row: no shuffle, no Python. A document's words and lines are arrays of that row.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blank characters between words, and the words themselves.
BLANKS = " \t\n\x0b\f\r"
BLANK, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: A document of fewer words, or with a larger share of repeated words in percent, fails the base rules.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: A document is rejected if lines that fail hold more than this share of its word characters, in percent.
MOST_LOST = 50

#: Rules of a line, in the order in which they are named as its reason; patterns that Java and RE2 read alike.
#: Boilerplate: phrases of licence, cookie and script notices, in lower case. Navigation: three separators or more, or a
#: menu word that begins a line of up to 60 characters. Punctuation: no end of a sentence anywhere in the line, or too many
#: marks or capitals for its size.
PHRASES = ["licensed under", "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "uses cookies", "accept cookies", "enable javascript", "copyright \u00a9", "copyright (c)", "lorem ipsum"]
SEPARATORS, LEAST_SEPARATORS = "|\u00bb\u203a\u2022\u00b7", 3
MENU = r"(?i)^[\x20\x09]*(home|menu|skip to|next|previous|log ?in|sign (in|up)|subscribe|share (on|this)|click here|read more|back to top)($|[^a-z].{0,55}$)"
SENTENCE = r"[.!?…。！？؟।][\"'”’»)\]]*([\x20\x09-\x0D]|$)"
#: Shares of a line's word characters, in percent, above which it fails the rule of punctuation as well, and the least
#: numbers of such characters: symbols with exclamation marks; capitals A-Z.
MOST_MARKS, LEAST_MARKS, MOST_CAPITALS, LEAST_CAPITALS = 8, 4, 50, 20
CAPITALS = "A-Z"
#: More than half of a line's word characters are capitals only if two of them are neighbours, blanks aside.
TWO_CAPITALS = r"[A-Z][\x20\x09-\x0D]*[A-Z]"


def let(value: Column, f) -> Column:
    """f(value), in which value is computed once for each row, however often f uses it. What the function of an array
    uses besides its element goes through this: a plan may put a column's expression in its place, for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def only(text: Column, characters: str) -> Column:
    """The characters of text that are in this class (of a pattern, without brackets)."""
    return F.regexp_replace(text, f"[^{characters}]+", "")


def how_many(text: Column, characters: str) -> Column:
    return F.length(only(text, characters)).cast("long")


def separators(line: Column) -> Column:
    """Number of separators; a class with such characters would be far slower than looking for each."""
    return sum((F.length(line) - F.length(F.replace(line, F.lit(c), F.lit(""))) for c in SEPARATORS), F.lit(0))


def word_characters(text: Column) -> Column:
    """Characters that are not blank."""
    return F.length(F.translate(text, BLANKS, "")).cast("long")


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK + "+", -1), lambda x: x != "")


def windows(w: Column) -> Column:
    """A 64-bit hash of each three words that follow each other; empty with fewer words."""
    every = let(w, lambda a: F.transform(a, lambda x, i: F.xxhash64(x, F.get(a, i + 1), F.get(a, i + 2))))
    return F.slice(every, 1, F.greatest(F.size(w) - 2, F.lit(0)))


def repeated_words(hashes: Column) -> Column:
    """Words that lie in a window (of these hashes) which is found twice or more. Where a hash repeats, windows
    are sorted with their positions; of those with an equal neighbour, each covers the words up to the next one's start."""
    placed = lambda g: F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    same = lambda s: F.filter(s, lambda x, k: x.h.eqNullSafe(F.get(s, k + 1).h) | x.h.eqNullSafe(F.get(s, k - 1).h))
    starts = lambda g: let(F.sort_array(placed(g)), lambda s: F.sort_array(F.transform(same(s), lambda x: x.i)))
    covered = lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return let(hashes, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(starts(g), covered))).cast("long")


def in_phrases(text: Column) -> Column:
    return let(F.lower(text), lambda t: reduce(or_, [t.contains(p) for p in PHRASES]))


def reason(line: Column, flags: Column) -> Column:
    """The first rule that a line fails, else null; a blank line fails none. The flags say whether the line's whole text
    has a phrase, a separator, marks and neighbouring capitals at all; without, their rules cannot fail and are not tried."""
    marks, capitals, size = how_many(line, SYMBOLS + "!"), how_many(line, CAPITALS), word_characters(line)
    return (
        F.when(~line.rlike(WORD), F.lit(None).cast("string"))
        .when(flags.phrased & in_phrases(line), "boilerplate")
        .when((flags.separated & (separators(line) >= LEAST_SEPARATORS)) | line.rlike(MENU), "navigation")
        .when(~line.rlike(SENTENCE), "punctuation")
        .when(flags.marked & (marks >= LEAST_MARKS) & (100 * marks > MOST_MARKS * size), "punctuation")
        .when(flags.loud & (capitals >= LEAST_CAPITALS) & (100 * capitals > MOST_CAPITALS * size), "punctuation")
    )


def clean(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, reasons (one for each
    line, null if it stays), lost_chars, cleaned (the text without failed lines) and kept; columns of docs with these
    names are replaced, others stay as they are.

    Null and empty texts have no words: they fail the base rules, and are cleaned to an empty text. Repeated rows and equal
    texts are judged alike; a line equal to an earlier one counts as a duplicate but fails no rule for it. Texts of any
    length are judged whole, within one row. An empty table gives none."""
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "reasons", "lost_chars", "cleaned", "kept"]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in new]).alias("_row")
    got = docs.select(row).withColumn("_t", F.coalesce(F.col("_row.text"), F.lit("")))
    t = F.col("_t")
    got = got.select("_row", t, words(t).alias("_w"), F.split(t, "\n", -1).alias("_l"), only(t, SYMBOLS + "!").alias("_m"), reduce(or_, [t.contains(c) for c in SEPARATORS]).alias("_s"), in_phrases(t).alias("_p"), t.rlike(TWO_CAPITALS).alias("_c"))
    flags = F.struct(F.col("_p").alias("phrased"), F.col("_s").alias("separated"), (F.length("_m") >= LEAST_MARKS).alias("marked"), F.col("_c").alias("loud"))
    reasons = let(flags, lambda f: F.transform("_l", lambda x: reason(x, f)))
    got = got.select("*", windows(F.col("_w")).alias("_g"), reasons.alias("reasons"))
    lines = F.arrays_zip("_l", "reasons")
    worded = F.filter("_l", lambda x: x.rlike(WORD))
    lost = F.transform(F.filter(lines, lambda x: x.reasons.isNotNull()), lambda x: word_characters(x["_l"]))
    whole = F.size(F.filter("reasons", lambda x: x.isNotNull())) == 0
    got = got.select(
        "_row",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        how_many(F.col("_m"), SYMBOLS).alias("n_symbols"),
        let(worded, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_g")).alias("n_repeat_words"),
        F.size("_l").alias("n_lines"),
        "reasons",
        F.aggregate(lost, F.lit(0).cast("long"), lambda s, x: s + x).alias("lost_chars"),
        F.when(whole, t).otherwise(F.array_join(F.transform(F.filter(lines, lambda x: x.reasons.isNull()), lambda x: x["_l"]), "\n")).alias("cleaned"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    got = got.withColumn("base_failed", failed)
    got = got.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= MOST_LOST * F.col("word_chars")))
    return got.select(*[F.col(f"_row.`{c}`") for c in docs.columns if c not in new], *new)
