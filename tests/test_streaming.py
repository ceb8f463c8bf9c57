"""Streams give what batches give."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.plans.engine import Engine
from gleanery.sources import readers, sinks
from gleanery.sources.adapters import documents
from gleanery.streaming import events as E

SF = "/root/testdata/sf0.001"


def test_sessions_stream(spark, tmp_path):
    src = spark.read.parquet(f"{SF}/events.parquet")
    src.write.parquet(str(tmp_path / "in"))
    live = E.timed(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")), "1 minute")
    q = E.sessions(live, "user_id", "10 minutes", "event_type").writeStream.format("memory").queryName("s").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = E.sessions(E.timed(src), "user_id", "10 minutes", "event_type")
    assert spark.table("s").exceptAll(want).count() == 0 and spark.table("s").count() == want.count()


def sequential(rows, ttl):
    """One guard a key; a later one replaces it, the first event takes it."""
    standing, out = {}, set()
    for ms, event, path, i in sorted(rows, key=lambda r: (r[0], r[1], r[3])):
        if not event:
            standing[path] = ms
        elif standing.pop(path, -(1 << 40)) + ttl < ms:
            out.add(i)
    return out


def guard_rows(seed=5):
    rng = np.random.default_rng(seed)
    return [(int(rng.integers(0, 60_000)), bool(rng.random() < 0.6), str(rng.choice(list("abbbbb"))), k) for k in range(300)]


def test_guards(spark):
    rows = [(10_000, False, "a", 0), (11_000, True, "a", 1), (12_000, True, "a", 2), (20_000, False, "b", 0), (30_000, True, "b", 3), (5_000, True, "c", 4), (7_000, False, "d", 0), (12_000, True, "d", 5)]
    assert sequential(rows, 5000) == {2, 3, 4}
    for r in (rows, guard_rows()):
        df = spark.createDataFrame(r, "ms long, event boolean, path string, event_id long").withColumn("ts", F.timestamp_millis("ms"))
        got = [x.event_id for x in E.guarded(df.where("event"), df.where("NOT event"), "path").collect()]
        assert len(got) == len(set(got)) and set(got) == sequential(r, 5000)


def test_guard_stream(spark, tmp_path):
    rows = sorted(guard_rows(6))
    for k in range(3):
        part = spark.createDataFrame(rows[100 * k : 100 * k + 100], "ms long, event boolean, path string, event_id long")
        part.select("path", F.timestamp_millis("ms").alias("ts"), F.when(F.col("event"), "event").otherwise("guard").alias("kind"), "event_id").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, ts timestamp, kind string, event_id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = E.guard_stream(stream.withWatermark("ts", "1 minute"))
    q = out.writeStream.format("memory").queryName("guards").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [r.event_id for r in spark.table("guards").collect()]
    assert len(got) == len(set(got)) and set(got) == sequential(rows, 5000)


def test_engine(spark):
    e = Engine(spark, documents(spark, SF))
    hits = e.search('lex: "of the" -was\nvec: thou anan', k=5).collect()
    assert len(hits) == 5 and all("@@" in h.snippet for h in hits)
    first = e.docs.where("active").first()
    assert e.get("#" + first["hash"][:8]).count() == 1
    assert e.multi_get(["en/*1.md"]).count() > 0 and e.status().count() == 20
    new, change = e.update(e.docs.where("doc_id > 5").withColumn("modified", F.col("modified") + 1))
    assert new.where("NOT active").count() == 6 and change.where("change = 'removed'").count() == 6


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "kb/sub").mkdir(parents=True)
    (tmp_path / "kb/.hidden").mkdir()
    for name, text in (("a.md", "alpha"), ("sub/b.md", "beta"), ("blank.md", " "), (".hidden/c.md", "x"), ("d.txt", "no")):
        (tmp_path / "kb" / name).write_text(text)
    got = {r.path for r in readers.scan(spark, str(tmp_path / "kb")).collect()}
    assert got == {"a.md", "sub/b.md"}
    (tmp_path / "conf").write_text("# c\nA = 1 # one\nB=two\nA = 3\n\n")
    assert {(r.key, r.value) for r in readers.settings(spark, str(tmp_path / "conf")).collect()} == {("A", "3"), ("B", "two")}
    (tmp_path / "cost").write_text("# Log\n\n## [2024-01-02] small | ask | a question\n- input: 1,200\n- output: 30\n\n## [2024-01-03] large | sum | b\n- input: 5\n")
    assert [(r.provider, r.tokens_in, r.tokens_out) for r in readers.cost_log(spark, str(tmp_path / "cost")).orderBy("date").collect()] == [("small", 1200, 30), ("large", 5, 0)]
    (tmp_path / "store.json").write_text('{"version": 1, "items": [{"id": "x"}]}')
    (tmp_path / "bad.json").write_text("{broken")
    assert readers.json_store(spark, str(tmp_path / "store.json"), "id: STRING", 1).count() == 1
    assert readers.json_store(spark, str(tmp_path / "bad.json"), "id: STRING", 1).count() == 0
    (tmp_path / "bench.jsonl").write_text('{"query": "a", "expected": ["x"]}\n{"messages": [{"role": "user", "content": "b"}, {"role": "assistant", "content": "y\\nz"}]}\n')
    assert [(r.query, r.expected) for r in readers.benchmark_lines(spark, str(tmp_path / "bench.jsonl")).orderBy("query").collect()] == [("a", ["x"]), ("b", ["y", "z"])]
    rows = spark.createDataFrame([("p<1>", 'say "hi", you', 0.456, "b&c")], "path string, title string, score double, body string")
    assert sinks.formatted(rows, "csv").first()["text"] == 'p<1>,"say ""hi"", you",0.4560'
    assert sinks.formatted(rows, "xml").first()["text"] == '<file path="p&lt;1&gt;" score="0.46">b&amp;c</file>'
    with pytest.raises(ValueError):
        sinks.formatted(rows, "pdf")
    with pytest.raises(ValueError):
        sinks.pages(spark.createDataFrame([("c", "../x", "")], "category string, filename string, content string"), str(tmp_path / "pages"))
