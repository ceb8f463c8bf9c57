"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

A mask looks at five of eight consecutive words, so a seed still fits where the ignored words were replaced. Each
position of a training text gives one hash for each mask; those that a benchmark item has too are hits. Around a hit,
the whole item is laid over the text on the hit's diagonal and the words that agree are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Offsets that each mask looks at.
MASKS = ((0, 1, 3, 4, 7), (0, 2, 3, 5, 7), (0, 1, 2, 4, 6))
SPAN = 8
#: Seeds of benchmark items that are broadcast at a time; a larger benchmark is joined in blocks of items.
BLOCK_SEEDS = 300_000


def word_hashes(text: Column) -> Column:
    """Array of 64-bit hashes of the lower-cased runs of letters and digits."""
    clean = F.regexp_replace(F.lower(text), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return F.transform(F.split(clean, r"[^\p{L}\p{N}]+"), lambda w: F.xxhash64(w))


def _seed(words: Column, at: Column, mask: int) -> Column:
    return F.xxhash64(F.lit(mask), *[F.get(words, at + o) for o in MASKS[mask]])


def seeds(items: DataFrame) -> DataFrame:
    """item_id, j, seed, before: the seed at each position of (item_id, iw), and the same mask's one at j - 1."""
    rows = items.where(F.size("iw") >= SPAN).select("item_id", "iw", F.posexplode(F.slice("iw", F.lit(1), F.size("iw") - (SPAN - 1))).alias("j", "_"))
    each = F.array(*[F.struct(_seed(F.col("iw"), F.col("j"), m).alias("seed"), F.when(F.col("j") > 0, _seed(F.col("iw"), F.col("j") - 1, m)).alias("before")) for m in range(len(MASKS))])
    return rows.select("item_id", "j", F.explode(each).alias("s")).select("item_id", "j", "s.seed", "s.before")


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, start, matched, item_words for the diagonals that a run of hits begins on."""
    d = docs.select("doc_id", word_hashes(F.col("text")).alias("dw")).where(F.size("dw") >= SPAN)
    d = d.select("doc_id", "dw", F.posexplode(F.slice("dw", F.lit(1), F.size("dw") - (SPAN - 1))).alias("i", "_")).drop("_")
    each = F.array(*[_seed(F.col("dw"), F.col("i"), m) for m in range(len(MASKS))])
    d = d.select("doc_id", "dw", "i", F.posexplode(each).alias("m", "seed"))
    hits = d.join(F.broadcast(seeds(items)), "seed")  # the caller bounds the items
    prior = F.lit(None).cast("long")
    for m in range(len(MASKS)):
        prior = F.when((F.col("m") == m) & (F.col("i") > 0), _seed(F.col("dw"), F.col("i") - 1, m)).otherwise(prior)
    hits = hits.where(F.col("before").isNull() | ~F.col("before").eqNullSafe(prior))
    hits = hits.select("doc_id", "dw", "item_id", (F.col("i") - F.col("j")).alias("start"))
    hits = hits.join(F.broadcast(items.select("item_id", "iw")), "item_id")
    agree = F.size(F.filter(F.sequence(F.lit(0), F.size("iw") - 1), lambda k: F.get("dw", F.col("start") + k) == F.get("iw", k)))
    return hits.select("doc_id", "item_id", "start", agree.alias("matched"), F.size("iw").alias("item_words"))


def verbatim(docs: DataFrame, items: DataFrame, words: int) -> DataFrame:
    """As overlaps, for items of fewer than SPAN words, all of `words` words: every place that has all of them in order."""
    code = lambda w, at: F.xxhash64(F.lit(words), *[F.get(w, at + k) for k in range(words)])
    d = docs.select("doc_id", word_hashes(F.col("text")).alias("dw")).where(F.size("dw") >= words)
    d = d.select("doc_id", "dw", F.posexplode(F.slice("dw", F.lit(1), F.size("dw") - (words - 1))).alias("start", "_"))
    d = d.select("doc_id", "start", F.slice("dw", F.col("start") + 1, F.lit(words)).alias("own"), code(F.col("dw"), F.col("start")).alias("code"))
    short = items.where(F.size("iw") == words).withColumn("code", code(F.col("iw"), F.lit(0)))
    hits = d.join(F.broadcast(short), "code").where(F.col("own") == F.col("iw"))  # the caller bounds the items
    return hits.select("doc_id", "item_id", "start", F.lit(words).alias("matched"), F.lit(words).alias("item_words"))


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.5, least: int = 8) -> DataFrame:
    """doc_id, item_id, matched, item_words, start (in words): the best overlap of each document with each item of
    which at least `share` of the words, and `least` words, agree on one diagonal; of equal overlaps the first. An item
    of fewer than SPAN words, which no mask fits, counts where all its words stand in a text one after the other.

    Words are lower-cased, so case, white space and punctuation do not count. A text or item with null or no words has
    no row. Repeated rows of one doc_id count as one document, items of one item_id are each laid over; null ids are ids
    of their own. Other columns are ignored. An empty table gives no rows.
    """
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", word_hashes(F.col("text")).alias("iw"))
    items = items.where((F.size("iw") > 1) | (F.get("iw", F.lit(0)) != F.xxhash64(F.lit(""))))
    total = items.agg(F.sum(F.size("iw"))).first()[0] or 0
    lengths = sorted(r.n for r in items.select(F.size("iw").alias("n")).where(F.col("n") < SPAN).distinct().collect())  # SPAN - 1 at most
    blocks = max(1, -(-total * len(MASKS) // BLOCK_SEEDS))
    items = items.withColumn("_key", F.struct("item_id", F.hash("iw")))
    found = None
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("_key"), F.lit(blocks)) == b)
        # ids are carried as they are; the item's words tell apart items that share an id
        part = part.select(F.col("_key").alias("item_id"), "iw")
        for got in (overlaps(docs, part.where(F.size("iw") >= SPAN)), *(verbatim(docs, part, n) for n in lengths)):
            found = got if found is None else found.unionByName(got)
    found = found.where((F.col("item_words") < SPAN) | (F.col("matched") >= share * F.col("item_words")) & (F.col("matched") >= least))
    best = F.min(F.struct((-F.col("matched")).alias("m"), "start", "item_words"))
    out = found.select("doc_id", F.col("item_id.item_id").alias("item_id"), "start", "matched", "item_words").groupBy("doc_id", "item_id").agg(best.alias("b"))
    return out.select("doc_id", "item_id", (-F.col("b.m")).alias("matched"), F.col("b.item_words").alias("item_words"), F.col("b.start").alias("start"))
