"""Upkeep and answer operators on small cases that the test tables lack."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gleanery.operators import answers, upkeep


def test_polluted_by_ocr(spark):
    long = "a line of ordinary text that is long enough to count as one\n"
    mark = "![x](y.png)\n"
    rows = [("rows", (mark + "ab\n\ncd\nef\n") * 5 + long * 40, True), ("items", (mark + "- ab\n- cd\n- ef\n" + long) * 5 + long * 40, False), ("few marks", mark * 4 + "ab\n" * 900, False), ("small", mark * 6 + "ab\n" * 9, False), ("clean", (mark + long * 10) * 6, False), ("share", (mark + long + "ab\n" * 2 + long) * 5 + (long + "ab\n" * 2) * 20, True)]
    got = {r.k: r.p for r in spark.createDataFrame([r[:2] for r in rows], "k string, t string").select("k", answers.ocr_polluted(F.col("t")).alias("p")).collect()}
    assert got == {k: p for k, _, p in rows}


def test_paths_and_uris(spark):
    rows = [("a/b.PDF", "a/b.PDF.md", "b", "pdf"), ("n.md", "n.md", "n", "md"), ("x/.hidden", "x/.hidden.md", ".hidden", ""), ("none", "none.md", "none", "")]
    c = F.col("p")
    got = spark.createDataFrame([(r[0],) for r in rows], "p string").select("p", answers.sidecar(c), answers.stem(c), answers.extension(c)).collect()
    assert [tuple(r) for r in got] == rows
    one = spark.range(1).select(answers.open_uri("v", F.lit("a b/ü.md")), answers.file_uri(F.lit("/a b/c.md")), answers.is_wiki_path(F.lit("./wiki/x")), answers.is_wiki_path(F.lit("wikis/x"))).first()
    assert tuple(one) == ("obsidian://open?vault=v&file=a%20b%2F%C3%BC.md", "file:///a%20b/c.md", True, False)


def test_citation_modes(spark):
    a = spark.createDataFrame([(1, "text \n"), (2, "none"), (3, "lost")], "answer_id int, answer string")
    c = spark.createDataFrame([(1, 2, "s2"), (1, 1, "s1"), (1, 3, "s2"), (3, 1, "gone")], "answer_id int, pos int, source_id string")
    r = spark.createDataFrame([("s1", "raw/one.pdf"), ("s2", "raw/two.md")], "source_id string, path string")
    raw = {x.answer_id: x.answer for x in answers.cited(a, c, r).collect()}
    assert raw[2].endswith(answers.NO_SOURCE) and raw[3].endswith(answers.NOT_RESOLVED)
    assert raw[1].endswith("[[raw/one.pdf|one]], [[raw/two.md|two]]")
    assert {x.answer_id: x.answer for x in answers.cited(a, c, r, "sidecar").collect()}[1].endswith("[[raw/one.pdf.md|one]], [[raw/two.md|two]]")
    assert {x.answer_id: x.answer for x in answers.cited(a, c, r, "hidden").collect()}[2] == "none"


def test_states_and_renames(spark):
    docs = spark.createDataFrame([("a", "x"), ("b", "y")], "collection string, path string")
    with pytest.raises(ValueError, match="exists"):
        upkeep.rename_collection(docs, "a", "b")
    reg = spark.createDataFrame([("p", 1), ("q", 2)], "path string, v int")
    new = spark.createDataFrame([("q", 5, 1), ("q", 4, 2), ("r", 7, 1), ("r", 9, 1)], "path string, v int, at int")
    assert sorted(tuple(r) for r in upkeep.upserted(reg, new, "path", "at").collect()) == [("p", 1), ("q", 4), ("r", 9)]
    st = spark.createDataFrame([(1, 1, "pending"), (1, 2, "accepted"), (1, 3, "rejected"), (2, 1, "rejected"), (2, 2, "rejected"), (3, 1, "pending"), (4, 1, "rejected"), (4, 2, "accepted")], "id int, seq int, state string")
    assert {r.id: (r.state, r.n_rejected, r.barred) for r in upkeep.suggestion_states(st).collect()} == {1: ("rejected", 1, True), 2: ("rejected", 2, True), 3: ("pending", 0, False), 4: ("accepted", 1, True)}
    items = spark.createDataFrame([(k,) for k in (1, 3, 4, 5)], "id int")
    assert {r.id: r.propose for r in upkeep.may_propose(items, upkeep.suggestion_states(st)).collect()} == {1: False, 3: True, 4: False, 5: True}
    stores = spark.createDataFrame([("a", {"x": "1"}), ("b", None)], "collection string, context map<string,string>")
    assert [r.context for r in upkeep.drop_context(stores, F.lit("x")).orderBy("collection").collect()] == [None, None]
    assert answers.fetch_size(10) == 50 and answers.fetch_size(100) == 200 and answers.fetch_size(1, True) == 100_000
    assert upkeep.clear_vectors(docs, docs).count() == 0
