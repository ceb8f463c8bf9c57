"""Content-addressed document store: change detection, upserts, soft deletes, garbage collection and status.

A document is (collection, path) -> hash of its content; contents are kept once by hash. All operators take and
return DataFrames, so a store is whatever the caller reads and writes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["collection", "path"]


def contents(docs: DataFrame) -> DataFrame:
    """hash, first_id, copies, n_bytes: each distinct content once (insert-or-ignore by hash)."""
    return docs.groupBy("hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.min(F.octet_length("doc")).alias("n_bytes"))


def insert_ignore(old: DataFrame, new: DataFrame, key: str = "hash") -> DataFrame:
    """old and those rows of new that have an unknown key, one for each key."""
    return old.unionByName(new.dropDuplicates([key]).join(old.select(key), key, "left_anti"))


def orphans(content: DataFrame, docs: DataFrame) -> DataFrame:
    """Contents that no active document has."""
    return content.join(docs.where("active").select("hash"), "hash", "left_anti")


def referenced(content: DataFrame, docs: DataFrame) -> DataFrame:
    """Contents that an active document has."""
    return content.join(docs.where("active").select("hash"), "hash", "left_semi")


def needs_embedding(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """hash, path (the least), n_bytes of active contents without a first vector (seq 0), in the order of path."""
    todo = docs.where("active").join(vectors.where("seq = 0").select("hash"), "hash", "left_anti")
    return todo.groupBy("hash").agg(F.min("path").alias("path"), F.min(F.octet_length("doc")).alias("n_bytes")).orderBy("path")


def collection_stats(collections: DataFrame, docs: DataFrame) -> DataFrame:
    """collection, n_docs, n_active, last_modified; collections without documents are kept."""
    s = docs.groupBy("collection").agg(F.count("*").alias("n_docs"), F.count_if("active").alias("n_active"), F.max("modified").alias("last_modified"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return collections.join(s, "collection", "left").select("collection", zero("n_docs"), zero("n_active"), "last_modified")


def index_status(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: total_active, n_collections, needs_embedding (distinct contents), has_vectors, last_modified."""
    live = docs.where("active")
    todo = live.join(vectors.where("seq = 0").select("hash"), "hash", "left_anti").agg(F.count_distinct("hash").alias("needs_embedding"))
    all_ = live.agg(F.count("*").alias("total_active"), F.count_distinct("collection").alias("n_collections"), F.max("modified").alias("last_modified"))
    has = vectors.agg((F.count("*") > 0).alias("has_vectors"))
    return all_.crossJoin(todo).crossJoin(has)  # three tables of one row


def index_health(docs: DataFrame, now: int) -> DataFrame:
    """Days since the last change of an active document, rounded down."""
    return docs.where("active").agg(F.max("modified").alias("last_modified")).select("last_modified", F.floor((F.lit(now) - F.col("last_modified")) / 86400).alias("days_stale"))


def changes(old: DataFrame, scan: DataFrame) -> DataFrame:
    """collection, path, change: new, updated (other hash), retitled (same hash), unchanged, or removed."""
    o = old.select(*KEY, F.col("hash").alias("_h"), F.col("title").alias("_t"))
    s = scan.select(*KEY, "hash", "title")
    kind = F.when(F.col("_h").isNull(), "new").when(F.col("hash").isNull(), "removed").when(F.col("_h") != F.col("hash"), "updated").when(F.col("_t") != F.col("title"), "retitled").otherwise("unchanged")
    return s.join(o, KEY, "full").select(*KEY, kind.alias("change"))


def change_summary(change: DataFrame) -> DataFrame:
    kinds = ("new", "updated", "retitled", "unchanged", "removed")
    return change.agg(*[F.count_if(F.col("change") == k).alias(f"n_{k}") for k in kinds])


def upsert(old: DataFrame, scan: DataFrame) -> DataFrame:
    """The store after a scan: created stays on conflict, everything else is the scan's and becomes active; documents
    that the scan lacks become inactive."""
    o = old.select(*KEY, *[F.col(c).alias(f"_{c}") for c in ("title", "hash", "created", "modified", "active")])
    s = scan.select(*KEY, "title", "hash", "modified")
    here = F.col("hash").isNotNull()
    pick = lambda c: F.when(here, F.col(c)).otherwise(F.col(f"_{c}")).alias(c)
    return s.join(o, KEY, "full").select(*KEY, pick("title"), pick("hash"), F.coalesce("_created", "modified").alias("created"), pick("modified"), here.alias("active"))


def removed(docs: DataFrame, scan: DataFrame) -> DataFrame:
    """Active documents that the scan lacks."""
    return docs.where("active").join(scan.select(KEY), KEY, "left_anti").select(KEY)


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row for each key, the one with the greatest order (upsert of vectors, cache rows, states)."""
    others = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*others), order).alias("_r")).select(*key, "_r.*")


def batches(todo: DataFrame, max_docs: int = 64, max_bytes: int = 64 << 20) -> DataFrame:
    """collection, path, n_bytes, batch: a collection's documents in path order; a batch ends before the document that would
    be one too many or take its bytes over the limit."""
    from gleanery.operators.packing import packed

    return packed(todo, "collection", "path", "n_bytes", max_docs, max_bytes)


def lru(cache: DataFrame, keep: int) -> DataFrame:
    """The `keep` newest rows; ties by key."""
    return cache.orderBy(F.desc("created"), "key").limit(keep)


def duplicate_titles(docs: DataFrame) -> DataFrame:
    return docs.select("collection", "path", F.count("*").over(W.partitionBy("collection", "title")).alias("n_same_title"))
