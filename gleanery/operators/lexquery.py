"""The query languages: lexical expressions, and documents of typed lines (lex:, vec:, hyde:, intent:, expand:)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from gleanery.operators.search import ACCENTS, PLAIN

KINDS = ("lex", "vec", "hyde", "intent", "expand")


class QueryError(ValueError):
    """A query that cannot be run, with the reason."""


@dataclass(frozen=True)
class Unit:
    kind: str  # term, prefix or phrase
    words: tuple[str, ...]
    negated: bool = False


@dataclass
class TypedQuery:
    searches: list[tuple[str, str]] = field(default_factory=list)  # lex, vec, hyde in order
    intent: str | None = None
    expand: str | None = None


def words_of(text: str) -> tuple[str, ...]:
    low = text.lower().translate(str.maketrans(ACCENTS, PLAIN))
    return tuple(w for w in re.split(r"[\W_]+", low) if w)


def parse_lex(text: str) -> list[Unit] | None:
    """Units, all of which must match: "..." is a phrase, a leading - negates, a word with inner hyphens is a phrase, any
    other word a prefix. None if nothing is left, or nothing that is not negated."""
    check_lex(text)
    out = []
    for neg, quoted, plain in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', text):
        if plain.startswith("-"):
            neg, plain = "-", plain[1:]
        words = words_of(quoted or plain)
        if words:
            out.append(Unit("phrase" if quoted and len(words) > 1 or len(words) > 1 else "term" if quoted else "prefix", words, bool(neg)))
    return out if any(not u.negated for u in out) else None


def check_lex(text: str) -> None:
    if "\n" in text:
        raise QueryError("a lexical query has one line")
    if text.count('"') % 2:
        raise QueryError("a quote is not closed")


def check_semantic(text: str) -> None:
    if re.search(r'(^|\s)-(\w|")', text):
        raise QueryError("negation is for lexical queries only")


def parse_document(text: str) -> TypedQuery | None:
    """A document of typed lines; None for one plain line, which is to be expanded. Blank lines do not count."""
    lines = [(i, l.strip()) for i, l in enumerate(text.split("\n"), 1) if l.strip()]
    if not lines:
        raise QueryError("the query is empty")
    typed = [(i, m[1].lower(), m[2].strip()) for i, l in lines if (m := re.match(r"(?i)(lex|vec|hyde|intent|expand):(.*)$", l))]
    if not typed:
        if len(lines) > 1:
            raise QueryError("several lines need types: " + ", ".join(KINDS))
        return None
    if len(typed) < len(lines):
        bad = next(i for i, _ in lines if i not in {t[0] for t in typed})
        raise QueryError(f"line {bad} has no type")
    out = TypedQuery()
    for i, kind, value in typed:
        if not value:
            raise QueryError(f"line {i} is empty")
        if kind in ("intent", "expand"):
            if getattr(out, kind):
                raise QueryError(f"line {i}: a second {kind}")
            setattr(out, kind, value)
            continue
        (check_lex if kind == "lex" else check_semantic)(value)
        out.searches.append((kind, value))
    if out.expand and out.searches:
        raise QueryError("expand stands alone, or with intent")
    if not out.expand and not out.searches:
        raise QueryError("nothing to search for")
    return out


def expand(text: str) -> TypedQuery:
    """The rule-based expansion of a plain query: its words lexically, itself as a meaning, and a passage about it."""
    words = words_of(text)
    return TypedQuery([("lex", " ".join(words)), ("vec", text), ("hyde", f"This is about {text}.")])
