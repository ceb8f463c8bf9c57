"""The embedding job: contents without vectors are cut into chunks, given their prefix and embedded, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import passages as P
from gleanery.operators import context, store


def pending(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """hash, collection, path, doc of active contents without a first vector, each once, under its least path."""
    todo = docs.where("active").join(vectors.where("seq = 0").select("hash"), "hash", "left_anti")
    return todo.groupBy("hash").agg(F.min_by(F.struct("collection", "path", "doc"), F.struct("path", "collection")).alias("r")).select("hash", "r.*")


def chunked(todo: DataFrame, size: int = P.SIZE, overlap: int = P.OVERLAP) -> DataFrame:
    """hash, seq, pos, text of the chunks of todo (hash, path, doc); code breaks before declarations."""

    def run(frames):
        for f in frames:
            rows = [(h, i, p, t) for h, path, doc in zip(f["hash"], f["path"], f["doc"], strict=True) for i, (p, t) in enumerate(P.chunks(doc or "", size, overlap, min(P.REACH, size // 4), path))]
            yield pd.DataFrame(rows, columns=["hash", "seq", "pos", "text"])

    return todo.select("hash", "path", "doc").mapInPandas(run, "hash string, seq int, pos int, text string")


def embedded(todo: DataFrame, prefixes: DataFrame | None, embed: Callable[[Column], Column], size: int = P.SIZE, overlap: int = P.OVERLAP) -> DataFrame:
    """hash, seq, pos, text, embedding: each chunk embedded with its content's prefix in front. No vector is made twice: a
    content is in todo once."""
    c = chunked(todo, size, overlap).withColumn("_given", F.col("text"))
    c = context.prefixed(c, prefixes, "_given") if prefixes is not None else c
    return c.withColumn("embedding", embed(F.col("_given"))).select("hash", "seq", "pos", "text", "embedding")


def upserted(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """vectors with the rows of new in place of all those of their contents, so that no chunk of an earlier cut is left."""
    return vectors.join(new.select("hash").distinct(), "hash", "left_anti").unionByName(new.select(*vectors.columns))


def counted(docs: DataFrame, vectors: DataFrame, new: DataFrame, max_docs: int = 64, max_bytes: int = 64 << 20) -> DataFrame:
    """One row: contents to do, their bytes and batches, contents done, chunks made."""
    todo = pending(docs, vectors).select("collection", "path", F.octet_length("doc").cast("long").alias("n_bytes"))
    b = store.batches(todo, max_docs, max_bytes)
    want = b.agg(F.count("*").alias("contents"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes"), F.count_distinct("collection", "batch").alias("batches"))
    have = new.agg(F.count_distinct("hash").alias("done"), F.count("*").alias("chunks"))
    return want.crossJoin(have)  # two tables of one row
