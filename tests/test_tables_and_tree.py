"""Table functions in SQL, and the folder tree as a batch and a streaming source."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from gleanery.functions import passages as P
from gleanery.functions import tables
from gleanery.sources import tree

TEXT = "# One\n" + "a line of words here\n" * 120 + "\n## Two\nshort body of two\n" + "another line | with | bars | here\n" * 40


def test_table_functions(spark):
    tables.register(spark)
    spark.createDataFrame([(1, TEXT), (2, ""), (3, None)], "doc_id int, text string").createOrReplaceTempView("docs_t")
    got = spark.sql("SELECT doc_id, c.* FROM docs_t d, LATERAL chunks(d.text, 900, 100) c ORDER BY doc_id, seq").collect()
    assert [(r.seq, r.pos, r.text) for r in got if r.doc_id == 1] == [(i, *c) for i, c in enumerate(P.chunks(TEXT, 900, 100, 225))]
    bare = spark.sql("SELECT c.* FROM docs_t d, LATERAL chunks(d.text, with_text => false) c")
    assert bare.columns == ["seq", "pos"]
    s = spark.sql("SELECT doc_id, s.* FROM docs_t d, LATERAL sections(d.text) s WHERE doc_id = 1 ORDER BY idx").collect()
    assert [(r.title, r.level) for r in s] == [("One", 1), ("Two", 2)] and s[0].body == P.sections(TEXT)[0]["body"]
    assert "body" not in spark.sql("SELECT * FROM sections('# x', false)").columns
    assert spark.sql("SELECT s.line FROM docs_t d, LATERAL snippet(d.text, 'bars short') s WHERE doc_id = 1").first().line == 124
    for bad in ("chunks('x', 0)", "chunks('x', 10, 10)", "chunks('x', doc_id)", "snippet('x', 'y', 1)"):
        with pytest.raises(Exception, match="must be"):
            spark.sql(f"SELECT t.* FROM docs_t d, LATERAL {bad} t").collect()


def put(root, path, text, at):
    p = root / path
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)
    os.utime(p, (at, at))


FILES = {"a.md": "one", "x/b.md": "two", "x/y/c.md": "three", "x/y/z/d.md": "four", "w/e.md": "", "w/f.txt": "no", ".hidden/g.md": "no", "node_modules/h.md": "no", "x/.i.md": "no"}


def test_tree_in_parts(spark, tmp_path):
    tree.register(spark)
    for k, (p, t) in enumerate(FILES.items()):
        put(tmp_path, p, t, 1_700_000_000 + k)
    want = {p: t for p, t in FILES.items() if t != "no"}
    for parts in (1, 2, 3, 16):
        df = spark.read.format("tree").option("parts", parts).load(str(tmp_path))
        assert {r.path: r.doc for r in df.collect()} == want
    df = spark.read.format("tree").option("pattern", "*").option("ignore", "w/*").load(f"file://{tmp_path}")
    assert {r.path for r in df.where("folder IN ('x', 'x/y') AND extension = 'md'").collect()} == {"x/b.md", "x/y/c.md"}
    assert {r.path for r in df.where("path LIKE 'x/y%'").collect()} == {"x/y/c.md", "x/y/z/d.md"}
    late = F.lit(1_700_000_002).cast("timestamp")
    assert {r.path for r in df.where(F.col("modified") > late).collect()} == {"x/y/z/d.md"}
    plan = df.where("extension = 'md'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (isnotnull" not in plan or "extension" not in plan.split("BatchScan")[0].split("Filter")[-1] or "EqualTo(extension" in plan
    assert spark.read.format("tree").option("content", "false").load(str(tmp_path)).where("doc IS NULL").count() == len(want)
    assert spark.read.format("tree").load(str(tmp_path / "none")).count() == 0


def test_tree_stream_goes_on_from_its_offset(spark, tmp_path):
    tree.register(spark)
    root, seen = tmp_path / "root", []
    put(root, "a.md", "one", 1_700_000_000)
    put(root, "x/b.md", "two", 1_700_000_001)

    def run():
        q = spark.readStream.format("tree").load(str(root)).writeStream.foreachBatch(lambda df, n: seen.append(sorted((r.path, r.doc) for r in df.collect())))
        q = q.option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()

    run()
    put(root, "x/b.md", "changed", 1_700_000_005)
    put(root, "new/c.md", "three", 1_700_000_006)
    run()
    run()
    assert [s for s in seen if s] == [[("a.md", "one"), ("x/b.md", "two")], [("new/c.md", "three"), ("x/b.md", "changed")]]
