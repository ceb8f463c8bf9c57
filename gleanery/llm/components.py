"""Connected components of an edge table: contraction inside tasks, then alternating large-star and small-star steps.

What contraction leaves of the edges is a forest of each task. As long as that is at most HELD edges (16 bytes each), one
more contraction in one task, of that bounded size, ends it; beyond that bound, the star steps do, round by round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import discard, tidy, written

#: Edges that a task holds before it contracts them, and the most that a single task may finish.
HELD = 2_000_000


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (least node of a component, other node) that connect the same nodes."""
    ids, at = np.unique(np.append(a, b), return_inverse=True)
    at = at.ravel()
    x, y, up = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while len(x):
        p, q = up[x], up[y]
        open_ = p != q
        if not open_.any():
            break
        x, y, p, q = x[open_], y[open_], p[open_], q[open_]
        np.minimum.at(up, np.maximum(p, q), np.minimum(p, q))
        while (up[up] != up).any():
            up = up[up]
    far = np.flatnonzero(up != np.arange(len(ids)))
    return ids[up[far]], ids[far]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b: long) with what each task holds of them as stars around the least nodes."""

    def run(batches):
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            a, b = np.append(a, batch.column(0).to_numpy()), np.append(b, batch.column(1).to_numpy())
            if len(a) > HELD:
                a, b = contract(a, b)
                if len(a) > HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                    a, b = a[:0], b[:0]
        a, b = contract(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").mapInArrow(tidy(run), "a long, b long")


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: links every larger neighbour of a node to the least of the node and its neighbours. Small star: links
    the node and its smaller neighbours to the least of them. The minimum is an aggregate with partial sums, and rows of
    a node meet it in a join, of which adaptive execution can split a hub's partition."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    if not large:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    rows = both.where("v > u") if large else both
    out = rows.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    if not large:
        out = out.union(least.select(F.col("m"), F.col("u")))
    return out.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether all edges (a < b, distinct) are stars around their least nodes: no node is the end of two edges, and no
    centre is an end."""
    ends = edges.select(F.col("b").alias("n"), F.lit(1).alias("k"), F.lit(0).alias("r")).union(edges.select("a", F.lit(0), F.lit(1)))
    return not ends.groupBy("n").agg(F.sum("k").alias("k"), F.max("r").alias("r")).where("k > 1 OR k > 0 AND r > 0").limit(1).count()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, root (the least node of its component) of the nodes of edges (a, b: long). Self-loops and repeated edges do
    not count; without edges there are no rows. Each round is written to the shared folder, which cuts lineage, and the
    round before is deleted; the number of rounds grows with the logarithm of the largest component."""
    now = written(contracted(edges), "edges")
    small = now.count() <= HELD
    before, now = now, written(contracted(now.coalesce(1)) if small else now.distinct(), "edges")
    discard(before)
    for _ in range(0 if small else most):
        if _settled(now):
            small = True
            break
        before, now = now, written(contracted(_stars(_stars(now, True), False)).distinct(), "edges")
        discard(before)
    if not small:
        raise RuntimeError("components did not settle")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a"), F.col("a")).distinct())
