"""Korean terms by rule, and break points of code."""

from __future__ import annotations

import ast
import random
import re

import pytest
from pyspark.sql import functions as F

from gleanery.functions import code, korean
from gleanery.operators import passages
from gleanery.operators.index import Index

WORDS = {"데이터베이스를": ["데이터베이스", "를"], "서버에서": ["서버", "에서"], "서버에서부터": ["서버", "에서부터"], "나는": ["나는"], "BM25": ["bm25"], "5.8GHz": ["5.8ghz"], "sqlite-vec": ["sqlite-vec"], "관리": ["관리"], "프로젝트의": ["프로젝트", "의"], "API가": ["api", "가"]}


def test_terms(spark):
    rows = spark.createDataFrame([(w,) for w in [*WORDS, None]], "w string").select("w", korean.index_terms(F.col("w")).alias("i"), korean.content_terms(F.col("w")).alias("c")).collect()
    got = {r.w: (r.i, r.c) for r in rows}
    assert {w: i for w, (i, _) in got.items() if w} == WORDS and got[None] == ([], [])
    for w in WORDS:
        assert korean.query_terms(w) == got[w][1]


def test_terms_of_runs_beside_others(spark):
    """All words of a text at once give what each word gives by SPLIT."""
    rng = random.Random(3)
    texts = ["".join(rng.choice([*korean.PARTICLES, "가나", "다", "라마바", " ", "\n", "AB", "-", "9."]) for _ in range(rng.randrange(30))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "w string").select("w", korean.index_terms(F.col("w")).alias("i"), korean.content_terms(F.col("w")).alias("c")).collect()
    for r in rows:
        parts = [list(m.groups()) if (m := re.match(korean.SPLIT, t)) else [t] for t in re.findall(korean.TOKEN, r.w.lower())]
        assert r.i == [x for p in parts for x in p] and r.c == [p[0] for p in parts]


def test_search_without_particles(spark, tmp_path):
    texts = ["프로젝트의 일정을 관리한다", "일정 관리 프로젝트", "서버에서 데이터를 읽는다", "server data"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, doc string")
    ix = Index.build(docs, f"file://{tmp_path}/ix", {"body": "doc"}, "korean")
    hits = lambda q: {r.doc_id for r in ix.bm25(*korean.query_units(q)).collect()}
    assert hits("프로젝트를") == {0, 1} and hits("프로젝트가 일정은") == {0, 1} and hits("서버의 프로젝트 자료에") == {0, 1, 2} and hits("없음") == set()


def test_assembled():
    assert korean.assembled("서버에서 NanoVNA-V2를", lambda q: "server reader") == "lex: 서버 nanovna-v2 를\nvec: 서버에서 NanoVNA V2를\nlex: server reader"
    assert korean.assembled("plain words", lambda q: "never") == "lex: plain words\nvec: plain words"


PY = "import os\nfrom a import b\n\n\n" + "".join(f"@wrap\ndef f{k}(x):\n    s = 'def no(): # {{'\n" + "    x = x + 1\n" * 12 + f"    return x\n\n\nclass C{k}:\n    def m(self):\n        return {k}\n\n\n" for k in range(6))
TS = "import { a } from 'b'\n" + "".join(f"// function no() {{\nexport function f{k}(x: number) {{\n  const s = \"function no() {{\"\n" + "  x = x + 1\n" * 12 + f"  if (x) {{\n    g(x)\n  }}\n}}\n\nexport class C{k} {{\n  async m(a: string): void {{\n    return\n  }}\n}}\n\ninterface I{k} {{ a: string }}\n\nconst h{k} = (x) => {{\n  return x\n}}\n\n" for k in range(6))


def lines_at(text, breaks):
    return [(text[p : text.index("\n", p)].strip(), w) for p, w in sorted(breaks.items())]


def test_breaks():
    got = lines_at(PY, code.code_breaks(PY, "x/a.py"))
    assert got[:5] == [("import os", 60), ("from a import b", 60), ("@wrap", 90), ("class C0:", 100), ("def m(self):", 90)] and len(got) == 2 + 3 * 6
    got = lines_at(TS, code.code_breaks(TS, "a.ts"))
    assert [w for w, _ in got[:6]] == ["import { a } from 'b'", "export function f0(x: number) {", "export class C0 {", "async m(a: string): void {", "interface I0 { a: string }", "const h0 = (x) => {"]
    assert [s for _, s in got[:6]] == [60, 90, 100, 90, 100, 90] and len(got) == 1 + 5 * 6
    rust = "use a::b;\npub struct S { x: u8 }\nimpl S {\n    pub fn new() -> S {\n        S { x: 0 }\n    }\n}\npub enum E { A }\nfn main() {}\n"
    assert [s for _, s in lines_at(rust, code.code_breaks(rust, "m.rs"))] == [60, 100, 100, 90, 80, 90]
    assert code.code_breaks("def broken(:", "a.py") == {} and code.code_breaks(PY, "a.md") == {} and code.code_breaks(PY, None) == {}


@pytest.mark.parametrize(("text", "path"), [(PY, "a.py"), (TS, "a.ts")])
def test_no_function_is_cut(spark, text, path):
    """Functions are shorter than a chunk, so each chunk begins at a declaration."""
    rows = passages.chunk_code(spark.createDataFrame([(path, text)], "path string, doc string"), 500, 0, 400).orderBy("seq").collect()
    assert "".join(r.text for r in rows) == text and len(rows) > 3
    at = code.code_breaks(text, path)
    assert all(r.pos in at for r in rows[1:])
    if path == "a.py":
        assert all(ast.parse(r.text) is not None for r in rows)
    assert max(len(r.text) for r in rows) <= 500
