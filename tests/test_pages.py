from __future__ import annotations

import pytest

from gleanery.functions import pages as G
from gleanery.sources import config as C


def test_names():
    assert G.file_name("a b___c d!.md") == "a-b/c-d.md" and G.file_name("x\U0001f600.md") == "x-1f600.md"
    with pytest.raises(ValueError):
        G.file_name("!!!")
    assert G.numbered_free("a", {"a", "a.1"}) == "a.2"


def test_front_matter_and_sections():
    t = G.set_front_matter("---\nid: old\ntags: x\n---\nbody", {"id": "new", "hash": "h"})
    assert t == "---\ntags: x\nid: new\nhash: h\n---\nbody" and G.set_front_matter(t, {"id": "new", "hash": "h"}) == t
    once = G.put_section("# T\n\ntext", "Contents", "## Contents\nrow")
    assert G.put_section(once, "Contents", "## Contents\nrow") == once
    assert "mine" in G.keep_user_sections("# New", "# Old\n\n## Notes\nmine\n## Other\nx", ["Notes"])
    assert G.deleted_banner(G.deleted_banner("a")).count("deleted") == 1


def test_links():
    assert G.links_of("[[a/B.md|x]] [[c#d]] [[b]]") == ["b", "c"]
    assert G.strip_broken("see [[a]], [[gone]], and [[b]]\n- [[gone]]\n- [[a]]", {"a", "b"}) == "see [[a]], and [[b]]\n- [[a]]"


def test_index_and_log():
    i = G.index_update("# Index\n\n## Tools\n- [[old]]\n", [("Tools", "new", "- [[new]]: good"), ("Tools", "no", "- [[no]]"), ("Tools", "old", "- [[old]]")], {"new": "Tools", "other": "People", "old": "Tools"})
    assert i.count("[[old]]") == 1 and "- [[new]]: good" in i and "## People\n- [[other]]" in i and "[[no]]" not in i
    log = G.log_entry("# Log\n\n## [2024-01-01] first\n- [[x]]\n", "2024-01-02", "second", ["a", "lost"], {"a", "b"})
    assert log.startswith("# Log\n\n## [2024-01-02] second\n- [[a]]\n- [[b]]\n\n## [2024-01-01] first")


def test_config():
    all_ = C.collections("collections:\n  a: {path: /x, context: {'/': all}}\n  b: {path: /y, include_by_default: false}\n")
    assert C.chosen(all_, None) == ["a"] and C.chosen(all_, ["b"]) == ["b"]
    with pytest.raises(ValueError):
        C.chosen(all_, ["c"])
    got = C.patterns("patterns:\n- {id: p, regex: a}\n- {id: q, regex: '('}\n", "patterns:\n- {id: p, regex: b}\n")
    assert [(p["id"], p["regex"]) for p in got] == [("p", "b")]
    v = C.vocabulary("entity_types: [Tool, My Type]\nstandard_decompositions:\n- {umbrella_slug: x, components: [{slug: a}]}\n- {umbrella_slug: x, components: []}\n- {umbrella_slug: y, components: []}\n- {umbrella_slug: z, components: [{slug: '!'}]}\n")
    assert v["entity"][-1] == "my_type" and {k: d["state"] for k, d in v["decompositions"].items()} == {"x": "on", "y": "off"}
    t = C.append_decomposition("", "n", ["c1"])
    assert C.append_decomposition(t, "n", ["c2"]) == t and C.vocabulary(C.append_decomposition(t, "m", ["c3"]))["decompositions"].keys() == {"n", "m"}
