"""Filter interaction audit: what each filter removes in every order of filters, from counts of failure masks alone.

A document's failures are a mask of bits. Documents are counted for each part and mask; the subset-zeta transform turns
a part's counts into the survivors of every subset of filters, and each step of an order is the difference of two
neighbouring subsets. The same holds for labels. So 120 orders cost one pass over the texts.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.line_rules import CAPITALS, how_many, words

#: The filters of the query, by letter; the bit of a filter is its place.
FILTERS = "ABCDE"


def failures(text: Column) -> dict[str, Column]:
    """Conditions of a text (empty if null) that need no other row: under 200 words; fewer than half of its words
    distinct; over 2 % capitals A-Z; any of #$%&*|."""
    t = F.coalesce(text, F.lit(""))
    w = F.col("_w")
    n, distinct = F.size(w).cast("long"), F.size(F.array_distinct(w)).cast("long")
    return {
        "A": n < 200,
        "B": 100 * distinct < 50 * n,
        "C": 100 * how_many(t, CAPITALS) > 2 * F.length(t).cast("long"),
        "D": t.rlike("[#$%&*|]"),
    }


def bits(conditions: dict[str, Column], filters: str = FILTERS) -> Column:
    return sum((F.when(c, 1 << filters.index(k)).otherwise(0) for k, c in conditions.items()), F.lit(0))


def failed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic, n: documents for each part, failure mask and label. Texts are read once and left behind;
    what is shuffled is a digest, an id and a few flags.

    E, a text of a smaller doc_id: the least id of each digest is joined back to counts that are already summed up by id,
    part and label. Copies are first counted by (digest, part, mask, label), with the number of rows that have the group's
    own least id, so a text that very many documents share meets its least id in a few rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"), words(text).alias("_w"))
    rows = rows.select("doc_id", "part", "digest", bits(failures(F.col("text"))).cast("int").alias("mask"))
    # rows without an id keep out of the join's keys, spread by their digest
    rows = rows.withColumn("k", F.coalesce(F.col("doc_id"), F.xxhash64("digest", "part"))).withColumn("known", F.col("doc_id").isNotNull())
    flags = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("k")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).withColumn("known", F.lit(True))
    rows = rows.join(flags, ["k", "known"], "left")
    no = F.lit(False)
    rows = rows.select("doc_id", "part", "digest", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    key = ["digest", "part", "mask", "good", "toxic"]
    one = rows.groupBy("doc_id", *key).agg(F.count("*").alias("n"))
    groups = one.groupBy(*key).agg(F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"))
    least = groups.groupBy("digest").agg(F.min("first").alias("least"))
    groups = groups.join(least, "digest")
    # rows of the least id, and rows without an id, have no smaller one
    own = F.when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(0) + F.col("n_null")
    split = F.explode(F.array(F.struct(F.lit(0).alias("bit"), own.alias("n")), F.struct(F.lit(1 << FILTERS.index("E")).alias("bit"), (F.col("n") - own).alias("n"))))
    split = groups.select("part", "mask", "good", "toxic", split.alias("s")).where("s.n > 0")
    return split.groupBy("part", (F.col("mask") + F.col("s.bit")).alias("mask"), "good", "toxic").agg(F.sum("s.n").alias("n"))


def survivors(counts: np.ndarray) -> np.ndarray:
    """counts[..., mask] -> how many fail no filter of each subset, by the zeta transform: the sum over the masks within
    the subset's complement."""
    z, size = counts.copy(), counts.shape[-1]
    at = np.arange(size)
    b = 1
    while b < size:
        has = at[(at & b) > 0]
        z[..., has] += z[..., has ^ b]
        b *= 2
    return z[..., size - 1 - at]


def steps(counts: np.ndarray, filters: str = FILTERS) -> list[tuple]:
    """Of counts[kind, mask], kinds all, good and toxic: a row for each order of filters and each of its steps."""
    n = len(filters)
    s = survivors(counts)
    gone = lambda before, f: s[:, before] - s[:, before | 1 << f]  # noqa: E731  removed by f after the filters in `before`
    share = [int(sum(factorial(m.bit_count()) * factorial(n - 1 - m.bit_count()) * gone(m, f)[0] for m in range(1 << n) if not m >> f & 1)) for f in range(n)]
    out = []
    for order in permutations(range(n)):
        before = 0
        for k, f in enumerate(order):
            removed, good, toxic = (int(x) for x in gone(before, f))
            others = (1 << n) - 1 - (1 << f)
            row = (int(s[0, before | 1 << f]), removed, int(gone(0, f)[0]) - removed, int(gone(others, f)[0]), good, toxic, share[f])
            out.append(("".join(filters[x] for x in order), k + 1, *row))
            before |= 1 << f
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null text counts as empty, null source as the part ''. A document is a row: repeated rows count each, and rows of one
    id are no copies of each other. A row without an id has no smaller one and is none, and has no labels. Of several labels
    of one id any that is 1 counts; other columns are ignored. Very long texts are measured whole, within a row. An empty
    table gives no rows; parts are those that documents have."""
    size = 1 << len(FILTERS)
    n, at = F.col("n"), F.col("mask")
    kinds = {"all": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    masks = failed(docs, labels).groupBy("part", "mask").agg(*[F.sum(F.when(c, n).otherwise(0)).alias(k) for k, c in kinds.items()])
    parts = masks.groupBy("part").agg(*[F.array(*[F.sum(F.when(at == m, F.col(k)).otherwise(0)) for m in range(size)]).alias(k) for k in kinds])
    names = "filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    kind = {"filter_order": pa.string(), "step": pa.int32()}

    def run(batches):
        for b in batches:
            cols = [np.array(b.column(1 + k).to_pylist(), np.int64).reshape(-1, size) for k in range(3)]
            for i, part in enumerate(b.column(0).to_pylist()):
                rows = list(zip(*steps(np.stack([c[i] for c in cols])), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows[0])), *[pa.array(v, kind.get(c, pa.int64())) for c, v in zip(names, rows, strict=True)]], ["part", *names])

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in names[2:])
    return parts.select("part", *kinds).mapInArrow(run, schema)
