"""Source registry: reconciliation with a scan, re-ingest decisions, history look-ups, audits, cost and run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def reconcile(registry: DataFrame, scan: DataFrame) -> DataFrame:
    """id, action, new_path. registry: id, path, hash, tombstone. scan: path, hash.

    A live record whose path still has its hash is kept (duplicate, if the hash is at other paths too); one whose hash
    is elsewhere moves to the least such path, a tombstone is restored there; one whose path has another hash was
    modified; one that is nowhere becomes a tombstone, or stays one.
    """
    at = scan.groupBy("hash").agg(F.count("*").alias("n"), F.min("path").alias("least"))
    own = scan.select("path", F.col("hash").alias("_h"))
    j = registry.join(own, "path", "left").join(at, "hash", "left")
    here = F.col("_h").eqNullSafe(F.col("hash"))
    action = F.when(F.col("tombstone") & F.col("n").isNotNull(), "restore").when(F.col("tombstone"), "gone").when(here & (F.col("n") > 1), "duplicate").when(here, "keep").when(F.col("n").isNotNull(), "move").when(F.col("_h").isNotNull(), "modified").otherwise("tombstone")
    path = F.when(F.col("action").isin("move", "restore"), F.col("least")).otherwise(F.col("path"))
    return j.withColumn("action", action).select("id", "action", path.alias("new_path"))


def decide(rows: DataFrame) -> DataFrame:
    """Adds decision. rows: known, same_source, same_sidecar (null without sidecar), tombstone."""
    d = F.when(~F.col("known"), "ingest").when(F.col("tombstone"), "restore").when(F.col("same_source") & F.coalesce("same_sidecar", F.lit(True)), "skip").when(F.col("same_source"), "protect").otherwise("reingest")
    return rows.withColumn("decision", d)


def by_path(registry: DataFrame, paths: DataFrame) -> DataFrame:
    """path, id of the record that has or had each wanted path; the current path counts first, then the least id."""
    cur = registry.select("id", "path", F.lit(0).alias("_o"))
    old = registry.select("id", F.explode("history").alias("path"), F.lit(1).alias("_o"))
    hit = cur.union(old).join(paths, "path").groupBy("path").agg(F.min(F.struct("_o", "id")).alias("h"))
    return hit.select("path", F.col("h.id").alias("id"))


def resolve(registry: DataFrame) -> DataFrame:
    """id, state, path: no path for tombstones; an empty path falls back to the last that is not empty."""
    last = F.element_at(F.filter("history", lambda p: p != ""), -1)
    has = F.coalesce(F.nullif("path", F.lit("")), F.when(F.size(F.filter("history", lambda p: p != "")) > 0, last))
    return registry.select("id", F.when(F.col("tombstone"), "deleted").when(has.isNull(), "lost").otherwise("live").alias("state"), F.when(~F.col("tombstone"), has).alias("path"))


def moved(registry: DataFrame, moves: DataFrame) -> DataFrame:
    """registry after moves (id, to): history gets the new path, the tombstone goes."""
    j = registry.join(moves, "id", "left")
    go = F.col("to").isNotNull()
    return j.select("id", F.coalesce("to", "path").alias("path"), F.when(go, F.array_append("history", F.col("to"))).otherwise(F.col("history")).alias("history"), (F.col("tombstone") & ~go).alias("tombstone"))


def audit(files: DataFrame, ingested: DataFrame) -> DataFrame:
    """folder, n_files, n_ingested, n_missing, n_unsupported; unsupported files count among the missing."""
    j = files.join(ingested.select("path", F.lit(True).alias("_i")), "path", "left")
    done = F.coalesce("_i", F.lit(False))
    return j.groupBy("folder").agg(F.count("*").alias("n_files"), F.count_if(done).alias("n_ingested"), F.count_if(~done).alias("n_missing"), F.count_if(~F.col("supported")).alias("n_unsupported"))


def diff(registry: DataFrame, disk: DataFrame) -> DataFrame:
    """path, state: modified (other hash), missing on disk, or unknown to the registry."""
    j = registry.select("path", F.col("hash").alias("_r")).join(disk.select("path", "hash"), "path", "full")
    s = F.when(F.col("hash").isNull(), "missing").when(F.col("_r").isNull(), "unknown").when(F.col("_r") != F.col("hash"), "modified")
    return j.select("path", s.alias("state")).where("state IS NOT NULL")


#: USD for a million tokens in and out (parameters).
RATES = {"small": (0.1, 0.4), "medium": (0.5, 1.5), "large": (3.0, 15.0)}


def cost(log: DataFrame, rates=RATES) -> DataFrame:
    """Adds cost; an unknown provider has the highest rates."""
    dear = max(rates.values())
    pick = lambda k: F.coalesce(*[F.when(F.col("provider") == p, F.lit(r[k])) for p, r in rates.items()], F.lit(dear[k]))
    return log.withColumn("cost", F.col("tokens_in") / 1e6 * pick(0) + F.col("tokens_out") / 1e6 * pick(1))


def cost_rollup(log: DataFrame) -> DataFrame:
    """provider, n, total, percent (of everything), by provider; the window is over one row for each provider."""
    g = cost(log).groupBy("provider").agg(F.count("*").alias("n"), F.sum("cost").alias("total"))
    return g.withColumn("percent", 100 * F.col("total") / F.sum("total").over(W.partitionBy()))


def run_statistics(runs: DataFrame) -> DataFrame:
    """metric, n, mean, sd (sample), cv (percent), low, high. runs: metric, value."""
    m = F.avg("value")
    return runs.groupBy("metric").agg(F.count("*").alias("n"), m.alias("mean"), F.stddev_samp("value").alias("sd"), F.when(m != 0, 100 * F.stddev_samp("value") / m).otherwise(0.0).alias("cv"), F.min("value").alias("low"), F.max("value").alias("high"))


def core_names(names: DataFrame) -> DataFrame:
    """name, n_runs, core (in every run). names: run, name."""
    total = names.agg(F.count_distinct("run").alias("_n"))
    g = names.distinct().groupBy("name").agg(F.count("*").alias("n_runs"))
    return g.crossJoin(F.broadcast(total)).select("name", "n_runs", (F.col("n_runs") == F.col("_n")).alias("core"))  # one row


def hit_at(ranks: DataFrame) -> DataFrame:
    """difficulty (null for all), n, hit1, hit3, hit5. ranks: difficulty, rank (null for no hit)."""
    share = lambda k: F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0)))
    return ranks.rollup("difficulty").agg(F.count("*").alias("n"), share(1).alias("hit1"), share(3).alias("hit3"), share(5).alias("hit5"))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def set_distance(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))
