"""Texts that contain patterns, against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from gleanery.operators import containing as C


@pytest.mark.parametrize("q", [2, 4])
def test_characters(spark, q):
    rng = np.random.default_rng(q)
    texts = ["".join(rng.choice(list("ab日é "), int(rng.integers(0, 30)))) for _ in range(60)] + [None, ""]
    patterns = [t[2 : 2 + int(rng.integers(0, 9))] for t in texts[:40]] + [None, "zzzz", "", "ab"]
    t = spark.createDataFrame(list(enumerate(texts)), "text_id int, text string")
    p = spark.createDataFrame(list(enumerate(patterns)), "pattern_id int, pattern string")
    got = sorted(tuple(r) for r in C.containing(t, p, C.characters(q)).collect())
    assert got == sorted((i, k) for i, a in enumerate(texts) for k, b in enumerate(patterns) if a is not None and b is not None and b in a)


def test_words(spark):
    texts = ["the old mill stands by the river", "an old mill\nstands by", "old mill stands", None, "mill"]
    patterns = ["ld mill stan", "old mill stands", "mill", "by the riv", "no such words here", "old  mill stands"]
    t = spark.createDataFrame(list(enumerate(texts)), "text_id int, text string")
    p = spark.createDataFrame(list(enumerate(patterns)), "pattern_id int, pattern string")
    df = C.containing(t, p, C.all_words, C.inner_words)
    assert sorted(tuple(r) for r in df.collect()) == sorted((i, k) for i, a in enumerate(texts) for k, b in enumerate(patterns) if a and b in a)


def test_audit(spark):
    names = ["annual-report-2023", "abc", "ab", "notes", "xy-notes-zz", "nomatch", "annual", None]
    keys = ["source-annual-report", "source-abc", "ab", "source-my-notes-2", "source-notes", "other", None]
    want = {n: n is not None and any(k == f"source-{n}" or (len(c := k.replace("source-", "")) > 3 and len(n) > 3 and (c in n or n in c)) for k in keys if k) for n in names}
    files = spark.createDataFrame([(n, 1) for n in names], "name string, x int")
    assert {r.name: r.ingested for r in C.audited(files, spark.createDataFrame([(k,) for k in keys], "key string")).collect()} == want
    plan = C.audited(files, spark.createDataFrame([(k,) for k in keys], "key string"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_table_of_all_grams(spark, monkeypatch):
    """What is written grows with the patterns and what they find, not with the words of the texts; also by shuffles."""
    texts = spark.createDataFrame([(k, " ".join(f"w{(k + j) % 50}" for j in range(40))) for k in range(300)], "text_id int, text string")
    patterns = spark.createDataFrame([(k, " ".join(f"w{k + j}" for j in range(6))) for k in range(4)], "pattern_id int, pattern string")
    held, want = [], sorted((k, i) for k in range(300) for i in range(4) if (i - k) % 50 + 6 <= 40)
    write = C.written
    monkeypatch.setattr(C, "written", lambda df, tag: held.append(out := write(df, tag)) or out)
    assert sorted(tuple(r) for r in C.containing(texts, patterns, C.all_words, C.inner_words).collect()) == want
    assert max(t.count() for t in held) <= 4 * 4
    monkeypatch.setattr(C, "SMALL", 0)
    assert sorted(tuple(r) for r in C.containing(texts, patterns, C.all_words, C.inner_words).collect()) == want
