"""Text operators with state along a text, in Python: break points, chunks, snippets, sections, personal data."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from gleanery.functions.code import code_breaks

# Break points: pattern and score (fixed values).
BREAKS = [
    (r"\n#(?!#)", 100), (r"\n##(?!#)", 90), (r"\n###(?!#)", 80), (r"\n####(?!#)", 70), (r"\n#####(?!#)", 60), (r"\n######(?!#)", 50),
    (r"\n```", 80), (r"\n(?:---|\*\*\*|___)\s*\n", 60), (r"\n\n+", 20), (r"\n[-*]\s", 5), (r"\n\d+\.\s", 5), (r"\n", 1),
]
SIZE, OVERLAP, REACH, DECAY = 3600, 540, 800, 0.7


def break_points(text: str) -> dict[int, int]:
    """Best score at each position where a pattern fits."""
    best: dict[int, int] = {}
    for pattern, score in BREAKS:
        for m in re.finditer(pattern, text):
            best[m.start()] = max(score, best.get(m.start(), 0))
    return dict(sorted(best.items()))


def fences(text: str) -> list[tuple[int, int]]:
    """Spans of fenced code; one that is not closed ends with the text. A fence at the very start is not seen."""
    marks = [m.start() for m in re.finditer(r"\n```", text)]
    out = [(a, b + 4) for a, b in zip(marks[::2], marks[1::2], strict=False)]
    return [*out, (marks[-1], len(text))] if len(marks) % 2 else out


class Cuts:
    """A text's break points outside fenced code, with those of `more` (the better one at a place), as sorted arrays."""

    def __init__(self, text: str, more: dict[int, int] | None = None):
        points = break_points(text)
        for a, b in fences(text):
            points = {p: s for p, s in points.items() if p <= a or p >= b}
        for p, s in (more or {}).items():
            points[p] = max(s, points.get(p, 0))
        self.at = np.array(sorted(points), np.int64)
        self.score = np.array([points[p] for p in self.at.tolist()], float)

    def before(self, target: int, reach: int) -> int:
        """The break among the `reach` characters up to target that is worth most, the first of equal ones; its worth falls
        with the square of the distance. Without a break, target itself."""
        near = slice(np.searchsorted(self.at, target - reach, "left"), np.searchsorted(self.at, target, "right"))
        if near.start == near.stop:
            return target
        far = (target - self.at[near]) / reach
        return int(self.at[near][np.argmax(self.score[near] * (1 - DECAY * far * far))])


def spans(text: str, size: int, overlap: int, reach: int, more: dict[int, int] | None = None) -> Iterator[tuple[int, int]]:
    """Starts and ends of chunks: each ends at the best break before its largest size, if that leaves it any text, and the
    next one begins `overlap` earlier, if that is a step forwards."""
    cuts, last, start = Cuts(text, more) if len(text) > size else None, len(text), 0
    while True:
        most = start + size
        end = last if most >= last else cuts.before(most, reach)
        end = end if end > start else most
        yield start, end
        if end >= last:
            return
        start = end - overlap if end - overlap > start else end


def chunks(text: str, size: int = SIZE, overlap: int = OVERLAP, reach: int = REACH, path: str | None = None) -> Iterator[tuple[int, str]]:
    """(position, text) of overlapping chunks of at most `size` characters; together they cover the text. A path with the
    extension of code adds breaks before declarations."""
    for a, b in spans(text, size, overlap, reach, code_breaks(text, path) if path and len(text) > size else None):
        yield a, text[a:b]


def token_chunks(text: str, count, most: int = 900) -> Iterator[tuple[int, str]]:
    """Chunks of at most `most` tokens by count(text): a first pass by characters, then halves of what is too long."""
    todo = list(chunks(text, most * 3, most * 3 * 15 // 100))[::-1]
    while todo:
        pos, t = todo.pop()
        if count(t) <= most or len(t) < 2:
            yield pos, t
            continue
        half = len(t) // 2
        todo += [(pos + half, t[half:]), (pos, t[:half])]


def place(first: int, shown: int, total: int) -> str:
    """Header of an excerpt: its first line, its lines, and those before and after it."""
    return f"@@ -{first + 1},{shown} @@ ({first} before, {total - first - shown} after)"


def snippet(body: str, query: list[str], intent: list[str] = (), most: int = 500, at: int = 0, length: int = SIZE) -> tuple[int, str]:
    """(line, snippet): the line with most query terms (intent terms count 0.3, the first of equal lines), one line before and
    two after, under a header with its place. at: looks only around a chunk that starts there, and in the whole text where
    that gives a blank excerpt."""
    low, high = (max(0, at - 100), min(len(body), at + length + 100)) if at > 0 else (0, len(body))
    weights = [(t.lower(), 1.0) for t in query] + [(t.lower(), 0.3) for t in intent]
    part = body[low:high].split("\n")
    worth = [sum(w for t, w in weights if t in l.lower()) for l in part]
    line = worth.index(max(worth))
    shown = part[max(0, line - 1) : line + 3]
    text = "\n".join(shown)
    if at > 0 and not text.strip():
        return snippet(body, query, intent, most)
    skipped = body.count("\n", 0, low)
    short = text if len(text) <= most else text[: most - 3] + "..."
    return skipped + line + 1, place(skipped + max(0, line - 1), len(shown), body.count("\n") + 1) + "\n" + short


HEADING = re.compile(r"^(#{1,6})\s*(\S.*?)\s*#*\s*$")
SKIP = [("toc", r"^(toc|table of contents|목차|차례)"), ("appendix", r"^(appendix\b|부록)"), ("contact", r"^(contacts?|contact us|문의)"), ("revision", r"^(revision\b|change ?log|개정\s*이력|변경\s*이력)"), ("copyright", r"^(copyright|license|저작권)"), ("standard-overview", r"개요|overview|introduction|구조|structure|architecture|구성|composition|영역|domain|area|지식체계|body of knowledge")]


def heading_kind(title: str) -> str:
    low = title.lower().strip()
    return next((k for k, p in SKIP if re.search(p, low)), "normal")


def priority(kind: str, chars: int, acronyms: float, table: bool) -> str:
    if kind != "normal" or chars < 100:
        return "skip"
    return "core" if chars > 200 and (acronyms > 0.05 or table) else "support"


def sections(text: str, least: int = 5) -> list[dict]:
    """idx, level, title, start (line from 1), body, kind, priority. Headings inside fenced code do not count; what stands
    before the first is a section of level 0; a normal section of fewer than `least` characters joins the one before."""
    out: list[dict] = []
    now, fence = {"level": 0, "title": "", "start": 1, "body": []}, False
    for i, l in enumerate(text.split("\n"), 1):
        if l.startswith("```"):
            fence = not fence
        m = None if fence else HEADING.match(l)
        if m:
            out.append(now)
            now = {"level": len(m[1]), "title": m[2], "start": i, "body": []}
        else:
            now["body"].append(l)
    out.append(now)
    kept: list[dict] = []
    for s in out:
        s["body"] = "\n".join(s["body"]).strip()
        if not s["level"] and not s["body"] and len(out) > 1:
            continue
        s["kind"] = heading_kind(s["title"])
        if kept and s["kind"] == "normal" and len(s["body"]) < least:
            kept[-1]["body"] = "\n".join(x for x in (kept[-1]["body"], s["title"], s["body"]) if x)
            continue
        kept.append(s)
    for k, s in enumerate(kept):
        words = s["body"].split()
        share = sum(bool(re.fullmatch(r"[A-Z][A-Z0-9]{1,5}", w)) for w in words) / len(words) if words else 0.0
        table = any(l.count("|") >= 3 for l in s["body"].split("\n"))
        s |= {"idx": k, "priority": priority(s["kind"], len(s["body"]), share, table)}
    return kept


# Personal data: kind, pattern, group of the value, mask (fixed values). Labels stand in front of the value's group,
# as Python has no look-behind of free length.
PATTERNS = [
    ("brn", r"(?<!\d)(\d{3}-\d{2}-\d{5})(?!\d)", 1, "digits"),
    ("brn", r"사업자(?:등록)?번호[\s:：]*(\d{10})(?!\d)", 1, "digits"),
    ("corp-rn", r"법인(?:등록)?번호[\s:：]*(\d{6}-?\d{7})\b", 1, "digits"),
    ("ceo-labeled", r"(?:대표이사|대표자|CEO)\s*[:：]\s*([가-힣](?:[ \t]*[가-힣]){1,3})", 1, "full"),
    ("email", r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})", 1, "full"),
    ("phone", r"(?<!\d)(01\d-\d{3,4}-\d{4})(?!\d)", 1, "digits"),
]
#: Structural: kind, label, value, window of lines that are not empty, prefixes of values and of lines that rule a value out.
STRUCTURES = [("ceo-structural", r"대표이사|대표자|성명", r"[가-힣](?:[ \t]*[가-힣]){1,3}", 5, ("주식회사", "유한회사"), ("주소", "전화", "등기", "사업", "법인", "업태", "종목"))]


def find_personal(text: str, patterns=PATTERNS, structures=STRUCTURES) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, mask, value), sorted; a span found twice counts once."""
    out = {}
    for kind, pattern, group, mask in patterns:
        for m in re.finditer(pattern, text):
            out.setdefault((m.start(group), m.end(group)), (kind, mask))
    for kind, label, value, window, no_value, no_line in structures:
        for m in re.finditer(label, text):
            pos, left = m.end(), window + 1
            while left and pos <= len(text):
                end = text.find("\n", pos)
                end = len(text) if end < 0 else end
                line = text[pos:end]
                if line.strip():
                    left -= 1
                    if not any(line.strip().startswith(p) for p in no_line):
                        for v in re.finditer(value, line):
                            if not v[0].startswith(no_value):
                                out.setdefault((pos + v.start(), pos + v.end()), (kind, "full"))
                pos = end + 1
    return [(a, b, k, m, text[a:b]) for (a, b), (k, m) in sorted(out.items())]


def mask(text: str, spans) -> str:
    """Digits become * where the mask is digits, all characters else. Replaced from the end."""
    for a, b, _, how, _ in sorted(spans, reverse=True):
        text = text[:a] + ("".join("*" if c.isdigit() else c for c in text[a:b]) if how == "digits" else "*" * (b - a)) + text[b:]
    return text


def hide(text: str, spans, marker: str = "[hidden]") -> str:
    """Takes out the sentence around each span (up to 500 characters), else its line (up to 300), else 20 characters on
    both sides; ranges that touch become one."""
    ranges = []
    for a, b, *_ in spans:
        s = max((text.rfind(c, 0, a) for c in ".!?\n"), default=-1) + 1
        ends = [e for c in ".!?\n" if (e := text.find(c, b)) >= 0]
        e = min(ends) + (text[min(ends)] != "\n") if ends else len(text)
        if e - s > 500 or not ends:
            s, e = text.rfind("\n", 0, a) + 1, text.find("\n", b)
            e = len(text) if e < 0 else e
            if e - s > 300:
                s, e = max(0, a - 20), min(len(text), b + 20)
        ranges.append((s, e))
    merged: list[list[int]] = []
    for s, e in sorted(ranges):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(e, merged[-1][1])
        else:
            merged.append([s, e])
    for s, e in reversed(merged):
        text = text[:s] + marker + text[e:]
    return text


def named_entities(query: str) -> list[str]:
    """Acronyms, capitalised words but the first, words with inner capitals or digits, and runs of such words."""
    words = re.findall(r"[\w.+#-]+", query)
    good = [bool(re.search(r"[A-Z].*[A-Z]|[a-z][A-Z]|\d|[+#]", w)) or (w[:1].isupper() and i > 0) for i, w in enumerate(words)]
    out, run = [], []
    for w, g in zip([*words, ""], [*good, False], strict=True):
        if g:
            run.append(w)
        elif run:
            out.append(" ".join(run))
            run = []
    return list(dict.fromkeys(out))


def expansion_score(query: str, lines: list[str]) -> dict:
    """Format, variety and length of a query expansion (lex:, vec:, hyde: lines); total from 0 to 100."""
    kinds: dict[str, list[str]] = {}
    for l in lines:
        k, _, v = l.partition(":")
        kinds.setdefault(k.strip() if v else "bad", []).append(v.strip())
    good = sum(len(kinds.get(k, [])) for k in ("lex", "vec", "hyde"))
    form = 30 * good / len(lines) if lines else 0.0
    all_ = [v.lower() for k in ("lex", "vec") for v in kinds.get(k, [])]
    variety = 30 * len(set(all_)) / len(all_) if all_ else 0.0
    hyde = 20.0 if any(50 <= len(v) <= 300 for v in kinds.get("hyde", [])) else 5.0 if kinds.get("hyde") else 0.0
    words = set(query.lower().split())
    echo = sum(v == query.lower() for v in all_)
    quality = 20.0 * sum(bool(words & set(v.split())) for v in all_) / len(all_) if all_ else 0.0
    return {"format": round(form, 3), "diversity": round(variety, 3), "hyde": hyde, "quality": round(quality, 3), "total": round(max(0.0, form + variety + hyde + quality - 5 * echo), 3)}
