"""Greedy packing of an ordered list into batches, exact and without one task for a whole list.

A batch takes documents in order until the next one would be one too many, or would take its bytes over the limit; a
document larger than the limit is a batch of its own. Where a batch starts depends on all before it, but what a block of
the list needs to know of them is only how many documents of the open batch stand before it, which is at most the greatest
number of a batch. So each block gives, for each such number, the one with which it ends and how many batches it begins; the
driver threads the blocks together (a few numbers for each), and each block then marks its batches by itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.sources.shared import shared_dir


def starts(size: np.ndarray, fresh: np.ndarray, most: int, limit: int) -> np.ndarray:
    """For each place of a list, where the batch after one that begins there begins: at most `most` documents and `limit`
    bytes later, at least one document later, and at the latest where a new list begins (fresh)."""
    n = len(size)
    total = np.append(0, np.cumsum(size))
    by_bytes = np.searchsorted(total, total[:-1] + limit, "right") - 1
    edges = np.append(np.flatnonzero(fresh), n)
    by_list = edges[np.searchsorted(edges, np.arange(n), "right")]
    return np.minimum(np.minimum(np.maximum(by_bytes, np.arange(n) + 1), np.arange(n) + most), by_list)


def first_start(size: np.ndarray, fresh: np.ndarray, before: np.ndarray, most: int, limit: int) -> int:
    """Where the first new batch begins in a block whose open batch has documents of sizes `before`; may be its end."""
    if not len(before):
        return 0
    whole = starts(np.append(before, size), np.append(np.arange(len(before)) == 0, fresh), most, limit)
    return max(0, int(whole[0]) - len(before))  # below 0: not a batch that can be open


def threads(size: np.ndarray, fresh: np.ndarray, tail: np.ndarray, most: int, limit: int) -> tuple[list[int], list[int], int]:
    """For each number of documents before the block in the open batch, 0 to len(tail): the number in the open batch at its
    end, and how many batches begin in it; and how many begin after the last new list in the block, -1 if none does."""
    n, after = len(size), starts(size, fresh, most, limit)
    last, count = np.append(np.zeros(n, np.int64), n), np.zeros(n + 1, np.int64)
    for i in range(n - 1, -1, -1):  # of the chain of starts from i: the last one and their number
        j = int(after[i])
        last[i], count[i] = (i if j >= n else last[j]), 1 + count[j]
    at = [first_start(size, fresh, tail[len(tail) - c :], most, limit) for c in range(len(tail) + 1)]
    new = np.flatnonzero(fresh)
    return [int(n - last[a]) if a < n else n + c for c, a in enumerate(at)], [int(count[a]) for a in at], int(count[new[-1]]) if len(new) else -1


def packed(docs: DataFrame, group: str, order: str, size: str, most: int = 64, limit: int = 64 << 20, blocks: int | None = None) -> DataFrame:
    """group, order, size and batch of docs: batches of each group from 0, in the order of `order`, ties by size.

    Null and negative sizes count as 0; a null group is a group, a null order comes first; an empty table gives none.
    `blocks`: ranges of the ordered list, by default as many as shuffles have partitions; a range is one task's work, and a
    group may span many. The driver holds up to `most` sizes and some counts of each range."""
    spark = docs.sparkSession
    n = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(group, order, F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias(size))
    path = shared_dir(spark, "ordered")
    ordered = rows.repartitionByRange(n, group, order, size).sortWithinPartitions(group, order, size)
    ordered.select("*", F.monotonically_increasing_id().alias("_at"), F.spark_partition_id().alias("_part")).write.parquet(path)
    rows = spark.read.parquet(path)

    def listed(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        """A block in its order, its sizes, and where another group begins inside it."""
        t = t.sort_by("_at")
        key = t.column(group).combine_chunks().dictionary_encode("encode").indices.to_numpy()
        return t, t.column(size).to_numpy(), np.append(False, key[1:] != key[:-1])[: len(key)]

    def edge(key, t):
        """A block's first and last group, and the last sizes of the latter."""
        t, sizes, fresh = listed(t)
        tail = sizes[max(len(sizes) - most, np.flatnonzero(fresh)[-1] if fresh.any() else 0) :]
        lo, hi = (t.column(group).slice(k, 1).combine_chunks() for k in (0, t.num_rows - 1))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "lo": lo, "hi": hi, "one": pa.array([not fresh.any()]), "tail": pa.array([tail.tolist()], pa.list_(pa.int64()))})

    kind = dict(rows.dtypes)[group]
    blocks_ = sorted(rows.groupBy("_part").applyInArrow(edge, f"part int, lo {kind}, hi {kind}, one boolean, tail array<long>").collect(), key=lambda r: r.part)
    tails, held, before = {}, [], None
    for b in blocks_:
        new = before is None or before.hi != b.lo
        held = [] if new else held
        tails[b.part] = (new, list(held))
        held, before = ((held + b.tail) if b.one else b.tail)[-most:], b

    def fresh_of(key, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new, tail = tails[key[0].as_py()]
        fresh[:1] = new
        return fresh, np.array(tail, np.int64)

    def thread(key, t):
        _, sizes, fresh = listed(t)
        ends, begun, late = threads(sizes, *fresh_of(key, fresh), most, limit)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "ends": pa.array([ends], pa.list_(pa.int64())), "begun": pa.array([begun], pa.list_(pa.int64())), "late": pa.array([late], pa.int64())})

    found = {r.part: r for r in rows.groupBy("_part").applyInArrow(thread, "part int, ends array<long>, begun array<long>, late long").collect()}
    entry, inside, number = {}, 0, 0
    for b in blocks_:
        if tails[b.part][0]:
            inside = number = 0
        entry[b.part] = (inside, number)
        r = found[b.part]
        number = r.late if r.late >= 0 else number + r.begun[inside]
        inside = r.ends[inside]

    def mark(key, t):
        t, sizes, fresh = listed(t)
        fresh, tail = fresh_of(key, fresh)
        inside, number = entry[key[0].as_py()]
        after, at = starts(sizes, fresh, most, limit), first_start(sizes, fresh, tail[len(tail) - inside :], most, limit)
        out = np.full(len(sizes), number - 1, np.int64)
        while at < len(sizes):
            number = 0 if fresh[at] else number
            out[at : after[at]] = number
            at, number = int(after[at]), number + 1
        return t.drop_columns(["_at", "_part"]).append_column("batch", pa.array(out))

    schema = ", ".join(f"`{c}` {k}" for c, k in docs.select(group, order).dtypes) + f", `{size}` long, batch long"
    return rows.groupBy("_part").applyInArrow(mark, schema)
