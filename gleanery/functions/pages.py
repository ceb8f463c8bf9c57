"""Page texts: names, managed front matter, link repair, contents tables, user sections, log and index entries."""

from __future__ import annotations

import re

#: Front-matter keys that the engine writes (parameter).
MANAGED = ("id", "path", "hash", "size", "first_seen", "sidecar")
LINK = re.compile(r"\[\[([^\]|#]+)(#[^\]|]*)?(\|[^\]]*)?\]\]")


def file_name(path: str) -> str:
    """A path as a clean name: '___' parts folders, runs of other characters than letters, digits and $ become one dash,
    emoji their code points, the last part keeps its extension and case."""
    parts = path.replace("___", "/").split("/")
    out = []
    for i, p in enumerate(parts):
        stem, dot, ext = p.rpartition(".") if i == len(parts) - 1 and "." in p.strip(".") else (p, "", "")
        stem = re.sub(r"[\U0001F000-\U0001FAFF☀-➿]", lambda m: f"-{ord(m[0]):x}-", stem)
        stem = re.sub(r"[^\w$]+|_+", "-", stem).strip("-")
        if stem:
            out.append(stem + (dot + ext if ext else ""))
    if not out:
        raise ValueError("nothing is left of the name")
    return "/".join(out)


def split_front_matter(text: str) -> tuple[list[str], str]:
    m = re.match(r"---\n(.*?)\n?---\n?", text, re.S)
    return (m[1].split("\n"), text[m.end() :]) if m else ([], text)


def set_front_matter(text: str, values: dict[str, object], managed=MANAGED) -> str:
    """Replaces the managed keys, keeps all others in their order."""
    lines, body = split_front_matter(text)
    kept = [l for l in lines if l and l.split(":", 1)[0].strip() not in managed]
    return "---\n" + "\n".join([*kept, *(f"{k}: {v}" for k, v in values.items() if k in managed)]) + "\n---\n" + body


def links_of(text: str) -> list[str]:
    """Base names that a text links to, first seen first."""
    return list(dict.fromkeys(m[1].strip().rsplit("/", 1)[-1].removesuffix(".md").lower() for m in LINK.finditer(text)))


def strip_broken(text: str, known: set[str]) -> str:
    """Links to unknown pages go; doubled commas and spaces are tidied, bullets left empty are dropped."""
    low = {k.lower() for k in known}
    t = LINK.sub(lambda m: m[0] if m[1].strip().rsplit("/", 1)[-1].removesuffix(".md").lower() in low else "", text)
    t = re.sub(r"[ \t]+([,.;:])", r"\1", re.sub(r"(,\s*){2,}", ", ", re.sub(r"[ \t]{2,}", " ", t)))
    return "\n".join(l for l in t.split("\n") if not re.fullmatch(r"\s*[-*]\s*[,.;]?\s*", l))


def contents_table(sections: list[dict]) -> str:
    rows = [f"| {s['idx']} | {'#' * s['level']} | {s['title']} | {len(s['body'])} |" for s in sections]
    return "\n".join(["## Contents", "", "| no | level | title | characters |", "|-|-|-|-|", *rows, ""])


def put_section(text: str, heading: str, body: str) -> str:
    """Replaces the section of that heading, or adds it at the end; doing it twice changes nothing."""
    block = body if body.endswith("\n") else body + "\n"
    pattern = re.compile(rf"^## {re.escape(heading)}\n.*?(?=^## |\Z)", re.S | re.M)
    return pattern.sub(lambda _: block, text, count=1) if pattern.search(text) else text.rstrip("\n") + "\n\n" + block


def user_sections(text: str, names: list[str]) -> dict[str, str]:
    """Sections that users write into generated pages, by heading."""
    out = {}
    for n in names:
        if m := re.search(rf"^## {re.escape(n)}\n.*?(?=^## |\Z)", text, re.S | re.M):
            out[n] = m[0].rstrip("\n") + "\n"
    return out


def keep_user_sections(new: str, old: str, names: list[str]) -> str:
    for n, block in user_sections(old, names).items():
        if f"## {n}\n" not in new:
            new = new.rstrip("\n") + "\n\n" + block
    return new


def deleted_banner(text: str, note: str = "> The source of this page was deleted.") -> str:
    return text if note in text else note + "\n\n" + text


def log_entry(log: str, date: str, title: str, pages: list[str], written: set[str]) -> str:
    """The log with a new entry on top: links to pages that were not written are left out, written pages that the entry
    lacks are added."""
    shown = [p for p in pages if p in written] + sorted(written - set(pages))
    head, _, rest = log.partition("\n\n") if log.startswith("# ") else ("# Log", "", log)
    return f"{head}\n\n## [{date}] {title}\n" + "".join(f"- [[{p}]]\n" for p in shown) + ("\n" + rest if rest else "")


def index_update(index: str, additions: list[tuple[str, str, str]], written: dict[str, str]) -> str:
    """The index with new lines by category. additions: (category, page, line); written: page -> category. Lines for pages
    that were not written or are there already go, written pages without a line get a plain one."""
    have = set(links_of(index))
    by: dict[str, list[str]] = {}
    seen: set[str] = set()
    for cat, page, line in additions:
        if page in written and page not in have and page not in seen:
            seen.add(page)
            by.setdefault(cat, []).append(line)
    for page, cat in sorted(written.items()):
        if page not in have and page not in seen:
            by.setdefault(cat, []).append(f"- [[{page}]]")
    for cat, lines in by.items():
        m = re.search(rf"^## {re.escape(cat)}\n", index, re.M)
        if m:
            end = index.find("\n## ", m.end())
            end = len(index) if end < 0 else end
            index = index[:end].rstrip("\n") + "\n" + "\n".join(lines) + "\n" + index[end:]
        else:
            index = index.rstrip("\n") + f"\n\n## {cat}\n" + "\n".join(lines) + "\n"
    return index


def numbered_free(path: str, taken: set[str]) -> str:
    """path, or the first of path.1 to path.9 that is free."""
    for p in (path, *(f"{path}.{k}" for k in range(1, 10))):
        if p not in taken:
            return p
    raise ValueError("no free name is left")
