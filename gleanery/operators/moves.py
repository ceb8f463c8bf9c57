"""Rename and delete events on a registry, in their order, in batch and as a stream.

A record is known by its present path and by every path it ever had. An event names a path and belongs to the record that
reached that path before it, the first in the registry's order where several did. A rename gives the record a new path and
takes a tombstone back; a delete sets one. So a chain a to b, b to c ends at c, a swap works, and an event of an old path
still finds its record.

Who owns an event follows from earlier arrivals alone: the owner is the least id that can reach its path through events in
rising order. (Where a smaller id owned an event on the way, that id would reach the path as well.) So all that counts at a
time is the least id that reached each path by then. Events are cut into blocks by their order. A round replays blocks from
the paths' least ids at their starts, and gives those at their ends to later blocks; only blocks for which a path that they
name has got a lesser id are replayed again. Chains inside a block cost no round, so rounds go on while ids still spread
from block to block: two where a first block settles all, at most one more than there are blocks.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.sources.shared import written

#: Events of a block, which one task replays at a time.
SPAN = 1 << 18


def _replay(events: pa.Table, begin: pa.Table) -> tuple[pa.Table, list, list, list]:
    """A block's events (pos, path, to) in order with the owner of each, from the least ids (path, owner) at its start; all
    paths in it, and their least ids at its start and end."""
    events = events.sort_by("pos")
    names = pa.chunked_array([*events["path"].chunks, *events["to"].chunks, *begin["path"].chunks], pa.string()).combine_chunks().dictionary_encode()
    code, n = names.indices.to_pylist(), events.num_rows
    start = [None] * len(names.dictionary)
    for c, owner in zip(code[2 * n :], begin["owner"].to_pylist(), strict=True):
        start[c] = owner
    now, owners = start.copy(), []
    for c, to in zip(code[:n], code[n : 2 * n], strict=True):
        owner = now[c]
        owners.append(owner)
        if owner is not None and to is not None and (now[to] is None or owner < now[to]):
            now[to] = owner
    return events.append_column("owner", pa.array(owners, begin.schema.field("owner").type)), names.dictionary.to_pylist(), start, now


def owned(registry: DataFrame, events: DataFrame, span: int = SPAN) -> DataFrame:
    """k (seq, kind, old, new), path, to, owner of the events that a record owns. registry: id, path, history (array of
    paths, null for none). events: seq, kind (rename or delete), old, new; equal events count once, those without a seq or
    an old path, and renames without a new one, not at all."""
    e = events.where("seq IS NOT NULL AND old IS NOT NULL AND kind IN ('rename', 'delete') AND (kind = 'delete' OR new IS NOT NULL)")
    e = e.select(F.struct(F.col("seq").cast("long").alias("seq"), "kind", "old", F.when(F.col("kind") == "rename", F.col("new")).alias("new")).alias("k")).distinct()
    blocks = max(1, -(-e.count() // span))
    e = e.select("k", F.col("k.old").alias("path"), F.col("k.new").alias("to")).repartitionByRange(blocks, "k").sortWithinPartitions("k")
    e = written(e.withColumn("pos", F.monotonically_increasing_id()).withColumn("block", F.shiftright("pos", 33)), "events")
    had = F.array_distinct(F.concat(F.coalesce("history", F.array().cast("array<string>")), F.array("path")))
    begin = registry.select(F.explode(had).alias("path"), F.col("id").alias("owner")).where("path IS NOT NULL").groupBy("path").agg(F.min("owner").alias("owner"))
    begin, named = written(begin, "arrivals"), written(e.select("path", "block").distinct(), "named")
    kind = begin.schema["owner"].dataType
    ends = T.StructType([T.StructField("path", T.StringType()), T.StructField("block", T.LongType()), T.StructField("owner", kind)])

    def spread(events: pa.Table, begin: pa.Table) -> pa.Table:
        """The paths that have a lesser id at the block's end than at its start."""
        _, names, start, now = _replay(events, begin)
        new = [c for c, (was, is_) in enumerate(zip(start, now, strict=True)) if is_ != was]
        block = events["block"][0].as_py()
        return pa.table({"path": pa.array([names[c] for c in new], pa.string()), "block": pa.array([block] * len(new), pa.int64()), "owner": pa.array([now[c] for c in new], begin.schema.field("owner").type)})

    def owners(events: pa.Table, begin: pa.Table) -> pa.Table:
        return _replay(events, begin)[0].select(["k", "path", "to", "owner"])

    def replayed_by(run, events: DataFrame, starts: DataFrame, schema: T.StructType) -> DataFrame:
        return events.groupBy("block").cogroup(starts.groupBy("block")).applyInArrow(run, schema)

    starts = written(named.join(begin, "path").select("path", "block", "owner"), "starts")
    moved, todo = written(starts.sparkSession.createDataFrame([], ends), "ends"), starts.select("block").distinct()
    renames = e.where("to IS NOT NULL").select("pos", "block", "path", "to")
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    while True:
        got = replayed_by(spread, renames.join(todo, "block", "left_semi"), starts.join(todo, "block", "left_semi"), ends)
        moved = written(moved.unionByName(got).groupBy("path", "block").agg(F.min("owner").alias("owner")), "ends")
        rows = moved.withColumn("asks", F.lit(False)).unionByName(begin.select("path", F.lit(-1).cast("long").alias("block"), "owner", F.lit(False).alias("asks")))
        rows = rows.unionByName(named.select("path", "block", F.lit(None).cast(kind).alias("owner"), F.lit(True).alias("asks")))
        rows = rows.groupBy("path", "block").agg(F.min("owner").alias("owner"), F.max("asks").alias("asks"))
        was = starts.select("path", "block", F.col("owner").alias("was"))
        new = rows.withColumn("owner", F.min("owner").over(before)).where("asks AND owner IS NOT NULL").join(was, ["path", "block"], "left")
        new = written(new.select("path", "block", "owner", (~F.col("owner").eqNullSafe(F.col("was"))).alias("changed")), "starts")
        starts, todo = new.select("path", "block", "owner"), new.where("changed").select("block").distinct()
        if not todo.limit(1).count():
            whole = T.StructType([*e.select("k", "path", "to").schema.fields, T.StructField("owner", kind)])
            got = replayed_by(owners, e.join(starts.select("block").distinct(), "block", "left_semi"), starts, whole)
            return written(got.where("owner IS NOT NULL"), "owners")


def _own_path(past):
    """Whether a record's first rename puts the path that it had into its history."""
    return F.col("path").isNotNull() & ~F.array_contains(past, F.col("path"))


def replayed(registry: DataFrame, events: DataFrame, span: int = SPAN) -> DataFrame:
    """registry (id, path, history, tombstone) after the events: the path of its last rename, history with the path it had
    (if it lacks that) and each new one in order, and whether its last event is a delete. Records without events stay as they
    are. A history is one value, so a record's renames are held by one task; see latest for what needs only their number."""
    o = owned(registry, events, span)
    rename = F.col("k.kind") == "rename"
    per = o.groupBy(F.col("owner").alias("id")).agg(
        F.max_by(F.when(rename, F.col("to")), F.when(rename, F.col("k"))).alias("_to"),
        F.transform(F.sort_array(F.collect_list(F.when(rename, F.col("k")))), lambda k: k.new).alias("_more"),
        (F.max("k").getField("kind") == "delete").alias("_gone"),
    )
    past = F.coalesce("history", F.array().cast("array<string>"))
    own = F.when(_own_path(past), F.array("path")).otherwise(F.array().cast("array<string>"))
    return registry.join(per, "id", "left").select(
        "id",
        F.coalesce("_to", "path").alias("path"),
        F.when(F.col("_more").isNull(), F.col("history")).otherwise(F.concat(past, F.when(F.size("_more") > 0, own).otherwise(F.array().cast("array<string>")), "_more")).alias("history"),
        F.coalesce("_gone", "tombstone").alias("tombstone"),
    )


def latest(registry: DataFrame, events: DataFrame, span: int = SPAN) -> DataFrame:
    """id, path and tombstone as replayed gives them, and n_history, the number of paths in its history (null where that is
    null). No history is made, so a record may have any number of events."""
    o = owned(registry, events, span)
    rename = F.col("k.kind") == "rename"
    per = o.groupBy(F.col("owner").alias("id")).agg(
        F.max_by(F.when(rename, F.col("to")), F.when(rename, F.col("k"))).alias("_to"),
        F.count(F.when(rename, 1)).alias("_n"),
        (F.max("k").getField("kind") == "delete").alias("_gone"),
    )
    past = F.coalesce("history", F.array().cast("array<string>"))
    n = F.size(past) + F.when(F.col("_n") > 0, _own_path(past).cast("int") + F.col("_n")).otherwise(0)
    return registry.join(per, "id", "left").select(
        "id",
        F.coalesce("_to", "path").alias("path"),
        F.when(F.col("history").isNotNull() | F.col("_n").isNotNull(), n).cast("int").alias("n_history"),
        F.coalesce("_gone", "tombstone").alias("tombstone"),
    )


def followed(pages: DataFrame, before: DataFrame, after: DataFrame, day: str) -> DataFrame:
    """pages (page, id, text) of records whose path or tombstone changed: the front matter names the new path, and a page of
    a deleted source has a note with the day on top of its body, once. Other pages stay; links in them do too."""
    was = before.select("id", F.col("path").alias("_was"))
    now = after.select("id", F.col("path").alias("_now"), F.col("tombstone").alias("_gone"))
    rows = pages.join(was, "id", "left").join(now, "id", "left")
    line = F.concat(F.lit("vault_path: "), F.regexp_replace("_now", r"([\\$])", r"\\$1"))
    moved = F.col("_now").isNotNull() & (F.col("_now") != F.col("_was"))
    head = F.regexp_extract("text", r"\A(---\n(?s:.*?)\n---\n)", 1)
    body = F.substring(F.col("text"), F.length(head) + 1, F.length("text"))
    head = F.when(moved, F.regexp_replace(head, F.lit(r"(?m)^vault_path:.*$"), line)).otherwise(head)
    note = F.lit(f"> [!warning] source deleted ({day})\n\n")
    noted = F.coalesce(F.col("_gone"), F.lit(False)) & ~F.contains(body, F.lit("> [!warning] source deleted"))
    return rows.select("page", "id", F.concat(head, F.when(noted, note).otherwise(""), body).alias("text"))


def follow(stream: DataFrame, folder: str, span: int = SPAN):
    """A writer that keeps the registry under `folder` up to date with a stream of events (not started yet): version=n+1 is
    version n after micro-batch n. A micro-batch that is run again after a failure writes the same version anew. Events that
    come in a later micro-batch count as later ones."""

    def step(batch: DataFrame, n: int) -> None:
        replayed(registry_at(batch.sparkSession, folder, n), batch, span).write.mode("overwrite").parquet(f"{folder}/version={n + 1}")

    return stream.writeStream.foreachBatch(step)


def registry_at(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/version={version}")
