"""File events as streams: sessions for debounced batches, last rename wins, consume-once guards, late data.

Each function takes a batch or a streaming DataFrame. Streams need a watermark on a timestamp, which `timed` adds;
rows later than it are dropped, which batches do not do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def timed(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """events with ts as TIMESTAMP (the session's time zone) and a watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def sessions(events: DataFrame, key: str, gap: str, item: str) -> DataFrame:
    """key, first, last (start and end of the session window), n, items: events of a key without a pause of `gap`."""
    g = events.groupBy(F.session_window("ts", gap).alias("w"), key)
    return g.agg(F.count("*").alias("n"), F.size(F.collect_set(item)).alias("n_items")).select(key, F.col("w.start").alias("first"), F.col("w.end").alias("last"), "n", "n_items")


def last_wins(events: DataFrame, key: str, value: str, gap: str, order: str) -> DataFrame:
    """key, first, value: the value of the latest event of each session; ties by `order`."""
    g = events.groupBy(F.session_window("ts", gap).alias("w"), key)
    return g.agg(F.max_by(value, F.struct("ts", order)).alias("value")).select(key, F.col("w.start").alias("first"), "value")


def grace(events: DataFrame, start: str, seconds: int = 10) -> DataFrame:
    """Events of the first seconds after a start do not count."""
    return events.where(F.col("ts") >= F.lit(start).cast("timestamp") + F.expr(f"INTERVAL {seconds} SECONDS"))


def guarded(events: DataFrame, guards: DataFrame, key: str, ttl: str = "5 seconds") -> DataFrame:
    """key, ts, event_id of the events that no guard takes. A guard stands for its key until `ttl` has passed, a later guard
    takes its place, or an event comes, which it takes. So an event is taken if the row before it in its key's order of time
    (guards before events of one moment) is a guard that still stands.

    Rows of a key are looked at in spans of `ttl`, each with the span before it, so a key with very many rows is no single
    task's work."""
    micros = F.expr(f"unix_micros(timestamp '1970-01-01 00:00:00' + INTERVAL {ttl}) - unix_micros(timestamp '1970-01-01 00:00:00')")
    life = max(1, events.sparkSession.sql("SELECT 1").select(micros).first()[0])
    e = events.select(key, "ts", "event_id", F.lit(1).alias("_event"))
    rows = e.unionByName(guards.select(key, "ts", F.lit(None).cast(events.schema["event_id"].dataType).alias("event_id"), F.lit(0).alias("_event")))
    rows = rows.withColumn("_at", F.unix_micros("ts"))
    spans = F.explode(F.array(F.struct(F.floor(F.col("_at") / life).alias("span"), F.lit(True).alias("own")), F.struct((F.floor(F.col("_at") / life) + 1).alias("span"), F.lit(False).alias("own"))))
    rows = rows.select("*", spans.alias("_s"))
    w = W.partitionBy(key, "_s.span").orderBy("_at", "_event", "event_id")
    taken = (F.lag("_event").over(w) == 0) & (F.lag("_at").over(w) + life >= F.col("_at"))
    rows = rows.withColumn("_taken", F.coalesce(taken, F.lit(False)))
    return rows.where("_event = 1 AND _s.own AND NOT _taken").select(key, "ts", "event_id")


def guard_stream(events: DataFrame, key: str = "path", ttl_ms: int = 5000) -> DataFrame:
    """The same on a stream of (key, ts, kind: guard or event, event_id). A key's state is the time of the guard that stands,
    if one does, and goes when its time is over."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(k, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat([pd.DataFrame({"ts": pd.to_datetime([state.get[0] if state.exists else 0], unit="ms"), "kind": ["guard" if state.exists else "none"], "event_id": [-1]}), *[f[["ts", "kind", "event_id"]] for f in frames]], ignore_index=True)
        head, rest = rows.iloc[:1], rows.iloc[1:].assign(order=lambda d: d["kind"] != "guard").sort_values(["ts", "order", "event_id"], kind="stable")
        rows = pd.concat([head, rest], ignore_index=True)
        before = rows.shift(1)
        taken = (before["kind"] == "guard") & (before["ts"] + pd.Timedelta(ttl_ms, "ms") >= rows["ts"])
        last = rows.iloc[-1]
        ms = int(last["ts"].value // 1_000_000)
        if last["kind"] == "guard":
            state.update((ms,))
            state.setTimeoutTimestamp(ms + ttl_ms + max(1, state.getCurrentWatermarkMs() - ms))
        elif state.exists:
            state.remove()
        out = rows[(rows["kind"] == "event") & ~taken]
        yield pd.DataFrame({key: k[0], "ts": out["ts"], "event_id": out["event_id"].astype("int64")})

    return events.groupBy(key).applyInPandasWithState(run, f"{key} string, ts timestamp, event_id long", "guard long", "append", GroupStateTimeout.EventTimeTimeout)


def freshness(docs: DataFrame, stamp: int | None) -> DataFrame:
    """state (never, stale, fresh), n_stale: active documents changed after the index's stamp."""
    n = docs.where("active").agg(F.count_if(F.col("modified") > (stamp if stamp is not None else -1)).alias("n_stale"))
    return n.select(F.when(F.lit(stamp is None), "never").when(F.col("n_stale") > 0, "stale").otherwise("fresh").alias("state"), "n_stale")
