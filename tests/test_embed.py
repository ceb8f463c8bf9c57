"""The embedding job on a few documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.operators import embed

LONG = "".join(f"Sentence number {k} of a long document. " for k in range(60))


def test_job(spark):
    rows = [("a", "x.md", "h1", LONG, True), ("b", "w.md", "h1", LONG, True), ("a", "y.md", "h2", "short", True), ("a", "z.md", "h3", "done before", True), ("a", "q.md", "h4", "gone", False), ("a", "e.md", "h5", "", True)]
    docs = spark.createDataFrame(rows, "collection string, path string, hash string, doc string, active boolean")
    had = spark.createDataFrame([("h3", 0, [1.0]), ("h2", 1, [9.0])], "hash string, seq int, embedding array<double>")
    prefixes = spark.createDataFrame([("h1", "About h1"), ("h3", "no")], "hash string, prefix string")
    size = lambda t: F.array(F.length(t).cast("double"))
    todo = embed.pending(docs, had)
    assert {(r.hash, r.path) for r in todo.collect()} == {("h1", "w.md"), ("h2", "y.md"), ("h5", "e.md")}
    new = embed.embedded(todo, prefixes, size, 400, 40)
    out = sorted(new.collect(), key=lambda r: (r.hash, r.seq))
    one = [r for r in out if r.hash == "h1"]
    assert len(one) > 3 and all(r.embedding == [len(r.text) + len("About h1\n\n")] for r in one) and all(LONG[r.pos : r.pos + len(r.text)] == r.text for r in one)
    assert [r.embedding for r in out if r.hash == "h2"] == [[5.0]]
    after = {(r.hash, r.seq) for r in embed.upserted(had, new).collect()}
    assert ("h3", 0) in after and ("h2", 1) not in after and ("h2", 0) in after and len(after) == 1 + len(out)
    n = embed.counted(docs, had, new, 2, 1000).first()
    assert (n.contents, n.done, n.chunks, n.n_bytes) == (3, 3, len(out), len(LONG) + 5) and n.batches == 2
    assert embed.counted(docs, embed.upserted(had, new), new.limit(0)).first().contents == 0
