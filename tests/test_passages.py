from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanery.functions import passages as P
from gleanery.operators import lexquery as L
from gleanery.operators import paths


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n#`-.", max_size=600), st.integers(20, 80))
def test_chunks_cover_the_text(text, size):
    end = 0
    for pos, c in P.chunks(text, size, size // 6, size // 3):
        assert pos <= end and len(c) <= size and text[pos : pos + len(c)] == c
        end = max(end, pos + len(c))
    assert end == len(text)


def test_break_points_prefer_headings():
    assert P.break_points("a\n# b\n\nc") == {1: 100, 5: 20, 6: 1}
    text = "x" * 30 + "\n" + "y" * 20 + "\n# head\n" + "z" * 60
    chunk = next(iter(P.chunks(text, 70, 10, 40)))[1]
    assert text[len(chunk) :].startswith("\n# head")


def test_code_is_not_cut():
    assert P.fences("a\n```\nb\n```\nc") == [(1, 11)]
    assert P.fences("a\n```\nb") == [(1, 7)]


def test_token_chunks():
    got = list(P.token_chunks("word " * 500, lambda t: len(t.split()), 50))
    assert all(len(c.split()) <= 50 for _, c in got)


def test_snippet():
    line, s = P.snippet("one\ntwo\nthree needle\nfour\nfive\nsix", ["needle"])
    assert line == 3 and s.startswith("@@ -2,4 @@ (1 before, 1 after)\ntwo\n")


def test_snippet_around_a_chunk():
    body = "needle\n" + "x\n" * 200 + "other needle\n" + "\n" * 300 + "end"
    assert P.snippet(body, ["needle"], at=380, length=40)[0] == 202
    line, s = P.snippet(body, ["needle"], at=620, length=20)  # blank around there
    assert line == 1 and s.startswith("@@ -1,3 @@ (0 before, ")
    assert P.snippet("", ["a"]) == (1, "@@ -1,1 @@ (0 before, 0 after)\n")


def test_cut_weighs_score_and_distance():
    def cut(points, target, reach=P.REACH):
        return P.Cuts("", points).before(target, reach)

    assert cut({10: 20, 90: 1}, 100, 100) == 10 and cut({10: 20, 90: 10}, 100, 100) == 90
    assert P.Cuts("a\n```\n# b\n```\n").at.tolist() == [1, 13] and cut({}, 100) == 100


def test_sections():
    got = P.sections("intro text\n# One\nbody of one\n```\n# not a heading\n```\n## Contents\nabc\n#Tight\nlong enough body")
    assert [(s["level"], s["title"]) for s in got] == [(0, ""), (1, "One"), (1, "Tight")]
    assert P.heading_kind("Table of Contents") == "toc" and P.heading_kind("Plain") == "normal"


def test_personal_data():
    text = "번호 123-45-67890\n대표이사\n\n홍길동\n주식회사 테스트\nmail a.b@c.de now. Next."
    found = P.find_personal(text)
    assert {(k, v) for _, _, k, _, v in found} >= {("brn", "123-45-67890"), ("ceo-structural", "홍길동"), ("email", "a.b@c.de")}
    m = P.mask(text, found)
    assert "***-**-*****" in m and "홍길동" not in m and len(m) == len(text)
    h = P.hide(text, found)
    assert "a.b@c.de" not in h and h.endswith(" Next.")


def test_lex_parser():
    u = L.parse_lex('"of the" anti-virus word -gone')
    assert [(x.kind, x.words, x.negated) for x in u] == [("phrase", ("of", "the"), False), ("phrase", ("anti", "virus"), False), ("prefix", ("word",), False), ("prefix", ("gone",), True)]
    assert L.parse_lex("-only") is None
    with pytest.raises(L.QueryError):
        L.parse_lex('"open')


@pytest.mark.parametrize("text", ["", "lex: a\nplain", "a\nb", "intent: x", "lex:", "vec: a -b", "expand: a\nlex: b", "intent: a\nintent: b\nlex: c"])
def test_document_errors(text):
    with pytest.raises(L.QueryError):
        L.parse_document(text)


def test_document():
    assert L.parse_document("plain words") is None
    q = L.parse_document("lex: a\n\nvec: b c\nintent: d")
    assert q.searches == [("lex", "a"), ("vec", "b c")] and q.intent == "d"


@pytest.mark.parametrize(("glob", "yes", "no"), [("**/*.md", "a/b/c.md", "a/b.txt"), ("*.md", "a.md", "a/b.md"), ("{a,b}/?.md", "b/x.md", "c/x.md"), ("[!a]*", "b", "a")])
def test_glob(glob, yes, no):
    import re

    rx = re.compile(paths.glob_regex(glob))
    assert rx.match(yes) and not rx.match(no)


def test_expansion_score():
    s = P.expansion_score("quick fox", ["lex: quick fox jumps", "vec: a fox that is quick", "hyde: " + "x" * 60])
    assert s["format"] == 30 and s["total"] > 80
    assert P.expansion_score("q", [])["total"] == 0
