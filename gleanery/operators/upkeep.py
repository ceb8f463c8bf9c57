"""Upkeep of a store and its registry as table operators: deletions, renames, contexts, states, caches, index deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def purge_inactive(docs: DataFrame) -> DataFrame:
    """The rows that a hard delete of inactive documents leaves."""
    return docs.where("active")


def clear_vectors(vectors: DataFrame, docs: DataFrame, collection: str | None = None) -> DataFrame:
    """The vectors that stay when those of a collection (all without one) are cleared; a content that another collection
    has too keeps its vector."""
    if collection is None:
        return vectors.limit(0)
    others = docs.where(F.col("collection") != collection).select("hash").distinct()
    own = docs.where(F.col("collection") == collection).select("hash").distinct().join(others, "hash", "left_anti")
    return vectors.join(own, "hash", "left_anti")


def remove_collection(docs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Documents that stay, and hashes of contents that nothing refers to any more."""
    stay = docs.where(F.col("collection") != name)
    return stay, docs.select("hash").distinct().join(stay.select("hash"), "hash", "left_anti")


def rename_collection(docs: DataFrame, old: str, new: str) -> DataFrame:
    """docs with the collection renamed; an error where the new name is taken."""
    if docs.where(F.col("collection") == new).limit(1).count():
        raise ValueError(f"collection {new} exists")
    return docs.withColumn("collection", F.when(F.col("collection") == old, new).otherwise(F.col("collection")))


def set_context(stores: DataFrame, prefix: Column, text: Column) -> DataFrame:
    """stores (collection, context: map of prefix to text) with an entry put in or replaced."""
    have = F.coalesce("context", F.create_map().cast("map<string,string>"))
    return stores.withColumn("context", F.map_concat(F.map_filter(have, lambda k, _: k != prefix), F.create_map(prefix, text)))


def drop_context(stores: DataFrame, prefix: Column) -> DataFrame:
    """stores without an entry; a map that is empty then is null."""
    left = F.map_filter("context", lambda k, _: k != prefix)
    return stores.withColumn("context", F.when(F.size(left) > 0, left))


def contexts_listed(stores: DataFrame, overall: str | None = None) -> DataFrame:
    """collection, prefix, text: the overall context as collection '*' with an empty prefix, and all entries. Shown by
    collection, longest prefix first (place)."""
    rows = stores.select("collection", F.explode("context").alias("prefix", "text"))
    if overall is not None:
        rows = rows.union(rows.sparkSession.range(1).select(F.lit("*"), F.lit(""), F.lit(overall)))
    return rows.withColumn("place", F.row_number().over(W.partitionBy("collection").orderBy(F.desc(F.length("prefix")), "prefix")))


def index_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """What index maintenance has to do: path, op (insert, delete, update) of active documents whose content or title
    changed; a document that became inactive is a delete."""
    old = before.where("active").select("path", F.xxhash64("hash", "title").alias("_old"))
    new = after.where("active").select("path", F.xxhash64("hash", "title").alias("_new"))
    op = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(F.col("_old") != F.col("_new"), "update")
    return old.join(new, "path", "full").select("path", op.alias("op")).where("op IS NOT NULL")


def legacy_keys(scan: DataFrame, stored: DataFrame) -> DataFrame:
    """scan paths with the stored key each one is found by: the exact path, else its lower case, which is then renamed
    unless the exact path is taken by another row: path, key, how (exact, legacy, new)."""
    exact = stored.select(F.col("path").alias("_exact")).distinct()
    lower = stored.select(F.col("path").alias("_lower")).distinct()
    got = scan.join(exact, F.col("path") == F.col("_exact"), "left").join(lower, F.lower("path") == F.col("_lower"), "left")
    how = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_lower").isNotNull(), "legacy").otherwise("new")
    return got.select("path", F.coalesce("_exact", "_lower").alias("key"), how.alias("how"))


def existing(planned: DataFrame, pages: DataFrame, key: str = "path") -> DataFrame:
    """planned with existed: whether a page of the key is there."""
    have = pages.select(F.col(key).alias("_have")).distinct()
    return planned.join(have, F.col(key) == F.col("_have"), "left").withColumn("existed", F.col("_have").isNotNull()).drop("_have")


def merged_by(base: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """base, and the rows of more whose key base lacks."""
    return base.unionByName(more.join(base.select(key).distinct(), key, "left_anti"))


def appended(history: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """history with new entries; an entry that is there already stays as it is, and equal new ones come once."""
    return merged_keys(history, new.dropDuplicates(key), key)


def merged_keys(base: DataFrame, more: DataFrame, key: list[str]) -> DataFrame:
    return base.unionByName(more.join(base.select(*key).distinct(), key, "left_anti"))


def upserted(registry: DataFrame, rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """registry in which rows replace those of their key or come in as new; of several rows of one key the last in `order`
    (a column of rows; without one the greatest row) stays."""
    cols = registry.columns
    last = rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*([order] if order else []), *cols)).alias("_r")).select("_r.*")
    return registry.join(last.select(key), key, "left_anti").unionByName(last)


def protect(pending: Column, path: Column) -> Column:
    """pending protections with a path put in once."""
    return F.array_union(F.coalesce(pending, F.array().cast("array<string>")), F.array(path))


def unprotect(pending: Column, path: Column) -> Column:
    return F.filter(pending, lambda x: x != path)


def duplicate_places(places: Column, path: Column, canonical: Column) -> Column:
    """Places of a duplicate with a path put in once, never the canonical one."""
    return F.array_remove(F.array_union(F.coalesce(places, F.array().cast("array<string>")), F.array(path)), canonical)


def suggestion_states(events: DataFrame) -> DataFrame:
    """id, state, n_rejected, barred from events (id, seq, state): each event replaces the state, so the last one counts; an id
    that was ever rejected is barred for good, whatever came after."""
    rejected = F.count_if(F.col("state") == "rejected")
    return events.groupBy("id").agg(F.max_by("state", F.struct("seq", "state")).alias("state"), rejected.alias("n_rejected"), (rejected > 0).alias("barred"))


def may_propose(items: DataFrame, states: DataFrame) -> DataFrame:
    """items (id) with propose: false where the suggestion is barred or accepted."""
    no = F.coalesce(F.col("barred") | (F.col("state") == "accepted"), F.lit(False))
    return items.join(states.select("id", "state", "barred"), "id", "left").withColumn("propose", ~no).drop("state", "barred")


def alive(cache: DataFrame, sources: DataFrame, now: int, days: int = 30) -> DataFrame:
    """Cache rows (key, source, written, n_bytes) that are neither expired nor orphans."""
    return cache.where(F.col("written") >= now - days * 86400).join(sources.select("source").distinct(), "source", "left_semi")


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes"))


def reset_preview(docs: DataFrame, scope: str) -> DataFrame:
    """scope, files and bytes that a reset of each scope would delete."""
    return docs.groupBy(F.col(scope).alias("scope")).agg(F.count("*").alias("files"), F.sum(F.coalesce(F.octet_length("doc"), F.lit(0))).alias("n_bytes"))


def needs_prefix(docs: DataFrame, cached: DataFrame, like: str | None = None, force: bool = False) -> DataFrame:
    """Active documents, by path pattern if given, that have no cached prefix of their content; all with force."""
    out = docs.where("active") if like is None else docs.where("active").where(F.col("path").like(like))
    return out if force else out.join(cached.select("hash").distinct(), "hash", "left_anti")


def export_outcomes(slugs: DataFrame, pages: DataFrame, vectors: DataFrame, size: int) -> DataFrame:
    """outcome (missing, no-vector, bad-size, exported), n: slugs (slug, first, other: paths by type and by the other type)
    whose page, vector and vector size are there."""
    p = pages.select(F.col("path").alias("_p"), "hash")
    a = slugs.join(p.withColumnsRenamed({"_p": "_a", "hash": "_ha"}), F.col("first") == F.col("_a"), "left")
    b = a.join(p.withColumnsRenamed({"_p": "_b", "hash": "_hb"}), F.col("other") == F.col("_b"), "left").withColumn("hash", F.coalesce("_ha", "_hb"))
    v = vectors.select("hash", F.col("n").alias("_n"))
    got = b.join(v, "hash", "left")
    what = F.when(F.col("hash").isNull(), "missing").when(F.col("_n").isNull(), "no-vector").when(F.col("_n") != size, "bad-size").otherwise("exported")
    return got.groupBy(what.alias("outcome")).agg(F.count("*").alias("n"))
