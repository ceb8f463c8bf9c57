"""Greedy batches against a sequential fold, with lists cut into blocks of every kind."""

from __future__ import annotations

import numpy as np
import pytest

from gleanery.operators.packing import packed


def fold(rows, most, limit):
    out, group, batch, n, total = {}, object(), -1, 0, 0
    for g, o, s in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2] or 0)):
        s = max(0, s or 0)
        if g != group:
            group, batch, n, total = g, 0, 0, 0
        elif n >= most or (n and total + s > limit):
            batch, n, total = batch + 1, 0, 0
        n, total = n + 1, total + s
        out.setdefault((g, o), []).append((s, batch))
    return out


@pytest.mark.parametrize(("n", "blocks", "most", "limit"), [(200, 7, 4, 100), (200, 40, 16, 1000), (60, 60, 30, 300), (5, 3, 64, 10), (1, 4, 2, 5)])
def test_packed(spark, n, blocks, most, limit):
    rng = np.random.default_rng(n + blocks)
    rows = [(str(rng.choice(["a", "a", "a", "b", "c"])), f"p{k:04d}", int(rng.integers(0, 70))) for k in range(n)]
    rows += [("a", "p0003", 500), (None, "x", 60), (None, "y", None), ("b", "p0001", -5)]
    got: dict = {}
    for r in packed(spark.createDataFrame(rows, "g string, o string, s long"), "g", "o", "s", most, limit, blocks).collect():
        got.setdefault((r.g, r.o), []).append((r.s, r.batch))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in fold(rows, most, limit).items()}


def test_limits(spark):
    rows = [("a", f"{k}", s) for k, s in enumerate((60, 60, 60, 10, 400, 5))]
    df = spark.createDataFrame(rows, "g string, o string, s long")
    assert [r.batch for r in sorted(packed(df, "g", "o", "s", 64, 100, 2).collect())] == [0, 1, 2, 2, 3, 4]
    assert packed(df.limit(0), "g", "o", "s").count() == 0
