"""Rename and delete events against a sequential replay, in batch and as a stream."""

from __future__ import annotations

import numpy as np
import pytest

from gleanery.operators import moves

SCHEMA, EVENT = "id long, path string, history array<string>, tombstone boolean", "seq long, kind string, old string, new string"


def replay(registry, events):
    """One event after the other; a record is found by its present and earlier paths, the first id first."""
    state = {i: [p, list(h or []), t, {p, *(h or [])}] for i, p, h, t in sorted(registry)}
    for _, kind, old, new in sorted(set(events)):
        r = next((r for r in state.values() if old in r[3]), None)
        if r is None:
            continue
        if kind == "delete":
            r[2] = True
        else:
            r[1] += [new] if r[0] in r[1] else [r[0], new]
            r[0], r[2] = new, False
            r[3].add(new)
    return {i: (p, h, t) for i, (p, h, t, _) in state.items()}


def got(df):
    return {r.id: (r.path, r.history or [], r.tombstone) for r in df.collect()}


CASES = {
    "chain": [(1, "rename", "a", "b"), (2, "rename", "b", "c")],
    "swap": [(1, "rename", "a", "t"), (2, "rename", "x", "a"), (3, "rename", "t", "x")],
    "deleted after a rename": [(1, "rename", "a", "b"), (2, "delete", "b", None)],
    "back from the dead": [(1, "delete", "a", None), (2, "rename", "a", "b")],
    "path used again": [(1, "rename", "a", "b"), (2, "rename", "x", "a"), (3, "delete", "a", None)],
    "unknown": [(1, "rename", "q", "r"), (2, "rename", "r", "a"), (3, "delete", "zz", None)],
    "old order": [(2, "rename", "a", "c"), (1, "rename", "a", "b"), (2, "rename", "a", "c")],
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    registry = [(1, "a", [], False), (2, "x", ["w"], False), (3, "y", None, True)]
    df = moves.replayed(spark.createDataFrame(registry, SCHEMA), spark.createDataFrame(CASES[name], EVENT))
    assert got(df) == replay(registry, CASES[name])


def random_log(seed):
    rng = np.random.default_rng(seed)
    registry = [(k, f"p{rng.integers(0, 12)}", [f"p{x}" for x in rng.integers(0, 12, rng.integers(0, 2))], False) for k in range(12)]
    events = [(int(s), "delete" if rng.random() < 0.2 else "rename", f"p{rng.integers(0, 30)}", f"p{rng.integers(0, 30)}") for s in range(60)]
    return registry, [(s, k, o, None if k == "delete" else n) for s, k, o, n in events]


@pytest.mark.parametrize("seed", [1, 2])
def test_random(spark, seed):
    registry, events = random_log(seed)
    df = moves.replayed(spark.createDataFrame(registry, SCHEMA), spark.createDataFrame(events, EVENT).repartition(3), span=7)
    assert got(df) == replay(registry, events)


def test_stream_is_batch(spark, tmp_path):
    registry, events = random_log(3)
    home = f"file://{tmp_path}/registry"
    spark.createDataFrame(registry, SCHEMA).write.parquet(f"{home}/version=0")
    for k in range(3):
        spark.createDataFrame(events[20 * k : 20 * k + 20], EVENT).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/events")
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/events")
    q = moves.follow(stream, home).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert got(moves.registry_at(spark, home, 3)) == replay(registry, events)


def test_empty_and_pages(spark):
    reg = spark.createDataFrame([(1, "a", [], False), (2, "b", [], False), (3, "c", [], False)], SCHEMA)
    none = spark.createDataFrame([], EVENT)
    assert got(moves.replayed(reg, none)) == got(reg) and moves.replayed(reg.limit(0), none).count() == 0
    odd = spark.createDataFrame([(None, "rename", "a", "q"), (1, "rename", None, "q"), (2, "rename", "a", None), (3, "other", "a", "q")], EVENT)
    assert got(moves.replayed(reg, odd)) == got(reg)
    after = moves.replayed(reg, spark.createDataFrame([(1, "rename", "a", "d/$1\\x"), (2, "delete", "b", None)], EVENT))
    page = "---\nid: 1\nvault_path: old\nnote: x\n---\nbody\nvault_path: stays\n"
    pages = spark.createDataFrame([("p1", 1, page), ("p2", 2, page), ("p3", 3, page), ("p4", 9, page), ("p5", 2, "no head")], "page string, id long, text string")
    out = {r.page: r.text for r in moves.followed(pages, reg, after, "2024-01-01").collect()}
    assert out["p1"] == page.replace("vault_path: old", "vault_path: d/$1\\x") and out["p3"] == out["p4"] == page
    assert out["p2"] == page.replace("body\n", "> [!warning] source deleted (2024-01-01)\n\nbody\n") and out["p5"].startswith("> [!warning]")
    twice = spark.createDataFrame([("p2", 2, out["p2"])], "page string, id long, text string")
    assert moves.followed(twice, reg, after, "2024-02-01").first().text == out["p2"]


def test_chain_in_few_rounds(spark, monkeypatch):
    """A chain of 20 links inside a block takes no round for each link."""
    tables = []
    monkeypatch.setattr(moves, "written", lambda df, tag, keep=moves.written: tables.append(tag) or keep(df, tag))
    registry, events = [(1, "p0", [], False)], [(k, "rename", f"p{k}", f"p{k + 1}") for k in range(20)]
    df = moves.replayed(spark.createDataFrame(registry, SCHEMA), spark.createDataFrame(events, EVENT))
    assert got(df) == replay(registry, events) and len(tables) <= 10


@pytest.mark.parametrize("seed", [4, 5])
def test_latest_makes_no_history(spark, seed):
    """Paths, tombstones and the number of paths are those of the whole replay, and no list of a record's events is made."""
    registry, events = random_log(seed)
    registry += [(100, None, None, False), (101, "p3", None, None), (102, "other", None, True)]
    df = moves.latest(spark.createDataFrame(registry, SCHEMA), spark.createDataFrame(events, EVENT), span=7)
    whole = moves.replayed(spark.createDataFrame(registry, SCHEMA), spark.createDataFrame(events, EVENT), span=7)
    want = {r.id: (r.path, None if r.history is None else len(r.history), r.tombstone) for r in whole.collect()}
    assert {r.id: (r.path, r.n_history, r.tombstone) for r in df.collect()} == want
    assert "collect_list" not in df._jdf.queryExecution().toString()


def test_queries_make_no_history(spark):
    from gleanery.plans import upkeep_queries as q

    for query in (q.rename_events, q.delete_events):
        assert "collect_list" not in query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
