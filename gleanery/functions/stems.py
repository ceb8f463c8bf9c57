"""Porter's suffix rules for English terms, as tables: Python for distinct terms of an Arrow batch, SQL for checks.

A word is a run of consonants and vowels; y is a vowel after a consonant. A rule takes the longest suffix of its step
that fits and applies if the part before it meets the condition; otherwise the step leaves the word as it is.
"""

from __future__ import annotations

import re
from functools import lru_cache

# The published rules, in their steps.
CONSONANTS, VOWELS = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
#: Conditions on the part before a suffix: measure over 0; over 1; over 1 with s or t at the end; measure 1; a vowel; consonant-vowel-consonant at the end, the
#: last not w, x or y; any.
CONDITIONS = {
    "m>0": f"^({CONSONANTS})?{VOWELS}{CONSONANTS}",
    "m>1": f"^({CONSONANTS})?{VOWELS}{CONSONANTS}{VOWELS}{CONSONANTS}",
    "m>1 st": f"^({CONSONANTS})?{VOWELS}{CONSONANTS}{VOWELS}.*[st]$",
    "m=1": f"^({CONSONANTS})?{VOWELS}{CONSONANTS}({VOWELS})?$",
    "v": f"^({CONSONANTS})?[aeiouy]",
    "cvc": f"^{CONSONANTS}[aeiouy][^aeiouwxy]$",
    "": "",
}
PLURALS = [("sses", "ss", ""), ("ies", "i", ""), ("ss", "ss", ""), ("s", "", "")]
SECOND = [
    ("ational", "ate", "m>0"), ("tional", "tion", "m>0"), ("enci", "ence", "m>0"), ("anci", "ance", "m>0"), ("izer", "ize", "m>0"), ("bli", "ble", "m>0"), ("alli", "al", "m>0"),
    ("entli", "ent", "m>0"), ("eli", "e", "m>0"), ("ousli", "ous", "m>0"), ("ization", "ize", "m>0"), ("ation", "ate", "m>0"), ("ator", "ate", "m>0"), ("alism", "al", "m>0"),
    ("iveness", "ive", "m>0"), ("fulness", "ful", "m>0"), ("ousness", "ous", "m>0"), ("aliti", "al", "m>0"), ("iviti", "ive", "m>0"), ("biliti", "ble", "m>0"), ("logi", "log", "m>0"),
]
THIRD = [("icate", "ic", "m>0"), ("ative", "", "m>0"), ("alize", "al", "m>0"), ("iciti", "ic", "m>0"), ("ical", "ic", "m>0"), ("ful", "", "m>0"), ("ness", "", "m>0")]
FOURTH = [(s, "", "m>1") for s in "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()] + [("ion", "", "m>1 st")]
#: After a removed ed or ing: these endings get an e back.
RESTORED = ("at", "bl", "iz")
#: Longer terms are not stemmed, as they are no words.
LONGEST = 64

_FITS = {k: re.compile(v) for k, v in CONDITIONS.items()}


def fits(condition: str, part: str) -> bool:
    return _FITS[condition].search(part) is not None


def ruled(word: str, rules: list[tuple[str, str, str]]) -> str:
    """The rule of the longest suffix that fits, if its condition holds."""
    suffix, new, condition = max((r for r in rules if word.endswith(r[0])), key=lambda r: len(r[0]), default=("", "", "none"))
    part = word[: len(word) - len(suffix)]
    return part + new if condition != "none" and fits(condition, part) else word


def past(word: str) -> str:
    """ed and ing go after a part with a vowel, which is then mended; eed becomes ee."""
    if word.endswith("eed"):
        return word[:-1] if fits("m>0", word[:-3]) else word
    part = next((word[: -len(s)] for s in ("ed", "ing") if word.endswith(s)), None)
    if part is None or not fits("v", part):
        return word
    if part.endswith(RESTORED) or fits("cvc", part):
        return part + "e"
    return part[:-1] if re.search(r"([^aeiouylsz])\1$", part) else part


@lru_cache(100_000)
def stem(word: str) -> str:
    """The stem of a lower-case term; terms of under three letters, very long ones, and those with a character beyond a-z
    stay as they are."""
    if not 3 <= len(word) <= LONGEST or not re.fullmatch("[a-z]+", word):
        return word
    # a first y is a consonant: it is set apart, so that the patterns need not know
    first = word[0] == "y"
    word = past(ruled("Y" + word[1:] if first else word, PLURALS))
    if word.endswith("y") and fits("v", word[:-1]):
        word = word[:-1] + "i"
    for rules in (SECOND, THIRD, FOURTH):
        word = ruled(word, rules)
    if word.endswith("e") and (fits("m>1", word[:-1]) or fits("m=1", word[:-1]) and not fits("cvc", word[:-1])):
        word = word[:-1]
    if word.endswith("ll") and fits("m>1", word[:-1]):
        word = word[:-1]
    return "y" + word[1:] if first else word


def stems_sql(table: str) -> str:
    """Common table expressions w0 to w7 in SQL: rows (term, w), of which w7 has each term's stem; table has the terms."""

    def has(condition: str, part: str) -> str:
        return f"regexp_matches({part}, '{CONDITIONS[condition]}')" if condition else "true"

    def step(rules) -> str:
        cases = "".join(f" WHEN ends_with(w, '{s}') THEN CASE WHEN {has(c, f'left(w, length(w) - {len(s)})')} THEN left(w, length(w) - {len(s)}) || '{n}' ELSE w END" for s, n, c in sorted(rules, key=lambda r: -len(r[0])))
        return f"CASE{cases} ELSE w END"

    cut = "CASE WHEN ends_with(w, 'eed') THEN NULL WHEN ends_with(w, 'ed') THEN left(w, length(w) - 2) WHEN ends_with(w, 'ing') THEN left(w, length(w) - 3) END"
    doubled = " OR ".join(f"ends_with(p, '{c}{c}')" for c in "bcdfghjkmnpqrtvwx")
    mended = f"""CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {has("m>0", "left(w, length(w) - 3)")} THEN left(w, length(w) - 1) ELSE w END WHEN p IS NULL OR NOT {has("v", "p")} THEN w
 WHEN {" OR ".join(f"ends_with(p, '{e}')" for e in RESTORED)} OR {has("cvc", "p")} THEN p || 'e' WHEN {doubled} THEN left(p, length(p) - 1) ELSE p END"""
    short = "left(w, length(w) - 1)"
    last = f"CASE WHEN ends_with(w, 'e') AND ({has('m>1', short)} OR {has('m=1', short)} AND NOT {has('cvc', short)}) THEN {short} ELSE w END"
    fine = f"length(term) BETWEEN 3 AND {LONGEST} AND regexp_full_match(term, '[a-z]+')"
    parts = [
        f"w0 AS (SELECT DISTINCT term, CASE WHEN left(term, 1) = 'y' THEN 'Y' || substring(term, 2) ELSE term END AS w FROM {table} WHERE {fine})",
        f"w1 AS (SELECT term, {step(PLURALS)} AS w FROM w0)",
        f"w2 AS (SELECT term, {mended} AS w FROM (SELECT term, w, {cut} AS p FROM w1))",
        f"w3 AS (SELECT term, CASE WHEN ends_with(w, 'y') AND {has('v', short)} THEN {short} || 'i' ELSE w END AS w FROM w2)",
        *[f"w{4 + k} AS (SELECT term, {step(r)} AS w FROM w{3 + k})" for k, r in enumerate((SECOND, THIRD, FOURTH))],
        f"w7 AS (SELECT term, CASE WHEN left(term, 1) = 'y' THEN 'y' || substring(w, 2) ELSE w END AS stem FROM (SELECT term, CASE WHEN ends_with(w, 'll') AND {has('m>1', short)} THEN {short} ELSE w END AS w FROM (SELECT term, {last} AS w FROM w6)))",
    ]
    return ", ".join(parts)
