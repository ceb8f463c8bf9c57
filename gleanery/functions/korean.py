"""Korean terms by rule: words lose the particle at their end, so that a noun is found with whatever particle follows it.

The index has both parts of a split word, a query the content part alone. All of it is JVM expressions; a word that no rule
splits stays whole in both, so the two always agree.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Particles and copula endings that follow nouns.
PARTICLES = (
    "에서부터 으로부터 에게서는 으로서는 으로써는 에서는 에게서 으로서 으로써 이라는 이라고 입니다 에서도 에게는 까지는 부터는 보다는 처럼은 "
    "에서 에게 에는 에도 으로 로서 로써 로는 로도 이다 이나 이며 이고 까지 부터 마다 조차 마저 밖에 처럼 보다 한테 께서 라는 라고 와는 과는 은 는 이 가 을 를 에 의 와 과 도 로 만 나 랑 께"
).split()
HANGUL = "가-힣"
#: Syllables that a word keeps at least when a particle goes.
KEPT = 2
#: Words of other letters and digits keep inner dots, hyphens and underscores.
TOKEN = f"[{HANGUL}]+|[A-Za-z0-9]+(?:[._\\-][A-Za-z0-9]+)*"
#: The shortest beginning that leaves a particle, so the longest particle goes.
SPLIT = f"^([{HANGUL}]{{{KEPT},}}?)({'|'.join(PARTICLES)})$"


def _ends() -> str:
    """The particles, by their first syllable."""
    rest: dict[str, list[str]] = {}
    for p in PARTICLES:
        rest.setdefault(p[0], []).append(p[1:])
    return "|".join(f"{a}(?:{'|'.join(b)})" for a, b in rest.items())


#: SPLIT for all words of a text at once: a run of Hangul is a token, whatever stands beside it.
SPLITS = f"(?<![{HANGUL}])([{HANGUL}]{{{KEPT},}}?)({_ends()})(?![{HANGUL}])"


def tokens(text: Column) -> Column:
    """Runs of Hangul, and words of other letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def index_terms(text: Column) -> Column:
    """All parts of all tokens, in order."""
    return tokens(F.regexp_replace(text, SPLITS, "$1 $2"))


def content_terms(text: Column) -> Column:
    """Tokens without their particles."""
    return tokens(F.regexp_replace(text, SPLITS, "$1"))


def query_terms(question: str) -> list[str]:
    """Content terms of a query, by the same rules."""
    found = re.findall(TOKEN, question.lower())
    return [m[1] if (m := re.match(SPLIT, t)) else t for t in found]


def has_korean(text: str) -> bool:
    return re.search(f"[{HANGUL}]", text) is not None


def query_units(question: str) -> tuple[list, bool]:
    """Prefix units of a query's terms, and whether a document must have all of them: it must of one or two, of three or
    more it needs one."""
    from gleanery.operators.lexquery import Unit

    terms = query_terms(question)
    return [Unit("prefix", (t,)) for t in terms], len(terms) <= 2


def assembled(question: str, translate: Callable[[str], str] | None = None) -> str:
    """The typed query of a question: its content terms, its meaning (hyphens would negate there), and for a Korean one the
    keywords that `translate` gives for other languages."""
    lines = [f"lex: {' '.join(query_terms(question)) or question}", f"vec: {question.replace('-', ' ')}"]
    if translate and has_korean(question) and (words := translate(question).strip()):
        lines.append(f"lex: {words}")
    return "\n".join(lines)
