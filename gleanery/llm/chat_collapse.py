"""Chat formatting: logged snapshots of a growing conversation collapse to the longest one, which is then rendered.

A turn's code is a pair of 64-bit hashes of (position, role, text). A prefix hash is the running XOR of the codes of
its turns, so it rolls along a window; the position in each code makes the XOR depend on order. A conversation whose
full hash is another, longer conversation's prefix hash is a snapshot of that one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed texts of the rendered form.
OPEN, BETWEEN, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def turn_codes() -> tuple:
    """Two hashes of a turn's role and text, in which null and empty differ."""
    role, text = [F.col("role").isNull(), F.col("role")], [F.col("text").isNull(), F.col("text")]
    return F.xxhash64(F.lit("a"), *role, *text).alias("a"), F.xxhash64(*text, *role, F.lit("b")).alias("b")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, i, n, p1, p2: hashes of the first i of n turns. One shuffle on conv_id, with the texts that part turns of
    one number."""
    w = W.partitionBy("conv_id").orderBy(*[F.col(c).asc_nulls_first() for c in ("turn", "role", "text")])
    t = turns.where(F.col("conv_id").isNotNull()).select("conv_id", *turn_codes(), F.row_number().over(w).alias("i"))
    t = t.select("conv_id", "i", F.xxhash64("i", "a", "b").alias("c1"), F.xxhash64("b", "i", "a").alias("c2"))
    run = W.partitionBy("conv_id").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy("conv_id")
    return t.select("conv_id", "i", F.count("*").over(whole).cast("int").alias("n"), F.bit_xor("c1").over(run).alias("p1"), F.bit_xor("c2").over(run).alias("p2"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations that prefix no longer one; equal ones are kept once, under
    their smallest conv_id. Prefix keys are made distinct before the anti-join, so a first turn that very many
    conversations share is one row in it."""
    p = prefix_hashes(turns)
    full = p.where("i = n").groupBy("n", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = p.where("i < n").select(F.col("i").alias("n"), "p1", "p2").distinct()
    return full.join(inner, ["n", "p1", "p2"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")


def collapse(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, rendered for each maximal conversation.

    Turns are ordered by turn, ties by role and text, null first; a repeated row is a turn of its own. Null roles render as
    empty, as do null texts, but differ from empty ones when conversations are compared. A conversation of very many turns
    is one value, so its window and its rendering are one task's work. Rows without conv_id are left out, an empty table
    gives none, other columns are ignored.
    """
    turns = turns.select("conv_id", "turn", "role", "text")
    keep = maximal(turns)
    rows = turns.join(keep.select("conv_id"), "conv_id", "left_semi")
    parts = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("l"))
    line = lambda x: F.concat(F.lit(OPEN), F.coalesce(x.role, F.lit("")), F.lit(BETWEEN), F.coalesce(x.text, F.lit("")), F.lit(CLOSE))
    text = parts.select("conv_id", F.array_join(F.transform("l", line), "").alias("rendered"))
    return keep.join(text, "conv_id")
