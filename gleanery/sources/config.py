"""Settings in YAML: collections, layered personal-data patterns, vocabularies with decompositions."""

from __future__ import annotations

import re

#: Built-in types (parameters of a vocabulary).
ENTITY_TYPES, CONCEPT_TYPES = ("person", "organization", "product", "tool"), ("standard", "method", "document_type")


def _load(text: str):
    import yaml

    return yaml.safe_load(text) or {}


def collections(text: str) -> list[dict]:
    """name, path, pattern, ignore, include, context of each collection; names are letters, digits, _ and -."""
    out = []
    for name, c in (_load(text).get("collections") or {}).items():
        if not re.fullmatch(r"[A-Za-z0-9_-]+", str(name)):
            raise ValueError(f"bad collection name: {name}")
        out.append({"name": name, "path": c["path"], "pattern": c.get("pattern", "**/*.md"), "ignore": list(c.get("ignore") or []), "include": bool(c.get("include_by_default", True)), "context": dict(c.get("context") or {})})
    return out


def chosen(all_: list[dict], names: list[str] | None) -> list[str]:
    """The wanted collections, by default those that are included; an unknown name is an error."""
    known = [c["name"] for c in all_]
    if names:
        if bad := [n for n in names if n not in known]:
            raise ValueError(f"unknown collection: {', '.join(bad)}")
        return names
    return [c["name"] for c in all_ if c["include"]]


def patterns(*layers: str) -> list[dict]:
    """Patterns of all layers; a later layer replaces an earlier one's pattern of the same id. Patterns that do not
    compile are left out."""
    out: dict[str, dict] = {}
    for text in layers:
        for p in _load(text).get("patterns") or []:
            try:
                re.compile(p.get("regex") or p["label"])
                re.compile(p.get("value", ""))
            except (re.error, KeyError):
                continue
            out[p["id"]] = p
    return list(out.values())


def type_name(name: str) -> str:
    return re.sub(r"[^a-z0-9_]", "_", name.lower())


def vocabulary(text: str) -> dict:
    """entity and concept types, and decompositions by umbrella: state (absent, off, or on) and components. Tabs are
    refused; built-in names are not redefined; the first decomposition of a slug holds; an empty list turns it off,
    one of which no component is valid does not."""
    if "\t" in text:
        raise ValueError("tabs are not allowed")
    data = _load(text)
    reserved = {*ENTITY_TYPES, *CONCEPT_TYPES}
    own = lambda k: [n for t in data.get(k) or [] if (n := type_name(t["name"] if isinstance(t, dict) else t)) not in reserved]
    out: dict = {"entity": [*ENTITY_TYPES, *own("entity_types")], "concept": [*CONCEPT_TYPES, *own("concept_types")], "decompositions": {}}
    for d in data.get("standard_decompositions") or []:
        slug, parts = d.get("umbrella_slug", ""), d.get("components")
        if not re.fullmatch(r"[a-z0-9][a-z0-9-]*", slug) or slug in out["decompositions"]:
            continue
        good = [c for c in parts or [] if re.fullmatch(r"[a-z0-9][a-z0-9-]*", c.get("slug", ""))]
        if parts == []:
            out["decompositions"][slug] = {"state": "off", "components": []}
        elif good:
            out["decompositions"][slug] = {"state": "on", "components": good}
    return out


def append_decomposition(text: str, slug: str, components: list[str]) -> str:
    """text with a new decomposition at its end; nothing changes for one that is there already, or was turned off."""
    if not re.fullmatch(r"[a-z0-9][a-z0-9-]*", slug):
        raise ValueError(f"bad slug: {slug}")
    data = _load(text)
    if any(d.get("umbrella_slug") == slug for d in data.get("standard_decompositions") or []):
        return text
    import yaml

    item = yaml.safe_dump([{"umbrella_slug": slug, "components": [{"slug": c} for c in components]}], sort_keys=False)
    if data.get("standard_decompositions"):
        data["standard_decompositions"].append({"umbrella_slug": slug, "components": [{"slug": c} for c in components]})
        return yaml.safe_dump(data, sort_keys=False, allow_unicode=True)
    return (text.rstrip("\n") + "\n" if text.strip() else "") + "standard_decompositions:\n" + item
