"""Retrieval: postings and BM25, exact k-NN, rank fusion with traces, position-aware blending, retrieval metrics."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Accented letters and what they fold to in the simple analyser (fixed values).
ACCENTS, PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüñç", "aaaaaaeeeeiiiiooooouuuunc"
K1, B = 1.2, 0.75
#: Weights of a match in path, title and body (fixed values).
FIELD_WEIGHTS = {"path": 1.5, "title": 4.0, "body": 1.0}
RRF_K, TOP_BONUS, NEAR_BONUS = 60, 0.05, 0.02


def fold(text: Column) -> Column:
    return F.translate(F.lower(text), ACCENTS, PLAIN)


def terms(text: Column) -> Column:
    """Lower-cased, accent-folded runs of letters and digits."""
    return F.filter(F.split(fold(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def postings(docs: DataFrame, fields: dict[str, str] | None = None) -> DataFrame:
    """doc_id, term, field, pos: one row for each token. fields: field name -> column."""
    fields = fields or {"path": "path", "title": "title", "body": "doc"}
    parts = [docs.select("doc_id", F.lit(f).alias("field"), F.posexplode(terms(F.col(c))).alias("pos", "term")) for f, c in fields.items()]
    return reduce(DataFrame.unionByName, parts)


def lengths(docs: DataFrame, fields: dict[str, str] | None = None) -> DataFrame:
    """doc_id, dl: tokens over all fields, without exploding them."""
    fields = fields or {"path": "path", "title": "title", "body": "doc"}
    return docs.select("doc_id", sum((F.size(terms(F.col(c))) for c in fields.values()), F.lit(0)).alias("dl"))


def matches(posts: DataFrame, units: DataFrame) -> DataFrame:
    """unit, doc_id, tf: weighted matches of each query unit (unit, kind: term, prefix or phrase; words: array).

    A prefix unit matches all tokens that begin so, a phrase consecutive tokens of one field. Units are a handful of
    rows of the query, so they are sent to the postings rather than the postings shuffled.
    """
    weight = F.coalesce(*[F.when(F.col("field") == f, F.lit(w)) for f, w in FIELD_WEIGHTS.items()])
    u = F.broadcast(units)
    single = posts.join(u.where("kind <> 'phrase'"), F.when(F.col("kind") == "prefix", F.col("term").startswith(F.col("words")[0])).otherwise(F.col("term") == F.col("words")[0]))
    single = single.select("unit", "doc_id", weight.alias("w"))
    at = u.where("kind = 'phrase'").select("unit", F.size("words").alias("n"), F.posexplode("words").alias("k", "term"))
    runs = posts.join(at, "term").groupBy("unit", "n", "doc_id", "field", (F.col("pos") - F.col("k")).alias("start")).agg(F.count_distinct("k").alias("c"))
    phrase = runs.where("c = n").select("unit", "doc_id", weight.alias("w"))
    return single.unionByName(phrase).groupBy("unit", "doc_id").agg(F.sum("w").alias("tf"))


def bm25(docs: DataFrame, units: DataFrame, fields: dict[str, str] | None = None) -> DataFrame:
    """doc_id, raw (negative, smaller is better), score = |raw| / (1 + |raw|) of documents that match every unit that is
    not negated and no negated one. idf = ln((N - n + 0.5) / (n + 0.5)), at least 1e-6."""
    m = matches(postings(docs, fields), units.select("unit", "kind", "words"))
    must = units.where("NOT negated").select("unit")
    n_must = must.count()
    good = m.join(F.broadcast(must), "unit")
    bad = m.join(F.broadcast(units.where("negated").select("unit")), "unit").select("doc_id").distinct()
    df = good.groupBy("unit").agg(F.count("*").alias("n"))
    dl = lengths(docs, fields)
    stats = dl.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    idf = F.log((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    s = good.join(F.broadcast(df), "unit").join(dl, "doc_id").crossJoin(F.broadcast(stats))  # one row of statistics
    s = s.groupBy("doc_id").agg(F.sum(part).alias("s"), F.count("*").alias("c")).where(F.col("c") == n_must)
    s = s.join(bad, "doc_id", "left_anti")
    return s.select("doc_id", (-F.col("s")).alias("raw"), (F.col("s") / (1 + F.col("s"))).alias("score"))


def scored(per: DataFrame, units: list, n: int, mean: float, every: bool) -> DataFrame:
    """doc_id, raw, score of rows (doc_id, dl, t0, t1, ...: weighted matches of each unit, null for none) that match every
    unit that is not negated (with every=False any of them) and no negated one. n, mean: documents and their mean length."""
    must = [i for i, u in enumerate(units) if not u.negated]
    counts = per.agg(*[F.count(f"t{i}").alias(f"n{i}") for i in must])
    s = F.lit(0.0)
    for i in must:
        idf = F.log((F.lit(n) - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        tf = F.col(f"t{i}")
        s = s + F.coalesce(F.when(idf <= 0, F.lit(1e-6)).otherwise(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / mean)), F.lit(0.0))
    for i, u in enumerate(units):
        if u.negated or every:
            per = per.where(F.col(f"t{i}").isNull() if u.negated else F.col(f"t{i}").isNotNull())
    if not every:
        per = per.where(F.coalesce(*[F.col(f"t{i}") for i in must]).isNotNull())
    out = per.crossJoin(F.broadcast(counts)).select("doc_id", s.alias("s"))  # one row of counts
    return out.select("doc_id", (-F.col("s")).alias("raw"), (F.col("s") / (1 + F.col("s"))).alias("score"))


def asked_once(docs: DataFrame, units: list, every: bool = True, analyser: Callable[[Column], Column] = terms, fields: dict[str, str] | None = None) -> DataFrame:
    """doc_id, raw, score as `Index.bm25` gives them, by one pass over docs (one row for each doc_id) and no shuffle: for a
    question to a table that no index is kept of. Units are terms and prefixes; phrases are an index's work."""
    from gleanery.sources.shared import written

    if any(u.kind == "phrase" for u in units):
        raise ValueError("phrases need an index")
    if not units or all(u.negated for u in units):
        return docs.sparkSession.createDataFrame([], "doc_id long, raw double, score double")
    fields = fields or {"path": "path", "title": "title", "body": "doc"}
    is_one = lambda t, u: t.startswith(u.words[0]) if u.kind == "prefix" else t == u.words[0]
    held = docs.select("doc_id", *[analyser(F.coalesce(F.col(c), F.lit(""))).alias(f) for f, c in fields.items()])
    only = lambda f, some: F.filter(F.col(f), lambda t: reduce(or_, [is_one(t, u) for u in some]))
    hits = [only(f, units).alias(f) for f in fields]
    held = held.select("doc_id", sum((F.size(f) for f in fields), F.lit(0)).alias("dl"), *hits)
    tf = [sum((F.size(only(f, [u])) * FIELD_WEIGHTS.get(f, 1.0) for f in fields), F.lit(0.0)) for u in units]
    per = written(held.select("doc_id", "dl", *[F.when(c > 0, c).alias(f"t{i}") for i, c in enumerate(tf)]), "unit-matches")
    n, total = per.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    return scored(per, units, n, total / max(1, n), every)


def top(rows: DataFrame, k: int, score: str = "score", key: str = "doc_id") -> DataFrame:
    return rows.orderBy(F.desc(score), key).limit(k)


def cosine(a: Column, b: Column) -> Column:
    """0 for different lengths, empty vectors and zero norms."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def knn(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id") -> DataFrame:
    """The k nearest rows: distance = 1 - cosine, ties by key. A scan with a bounded heap in each task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("distance", F.round(1 - cosine(F.col("embedding"), q), 6)).orderBy("distance", key).limit(k)


def knn_post_filter(vectors: DataFrame, query: list[float], k: int, where: Column) -> DataFrame:
    """k-NN over everything with 3 k results, then the filter, then k: the filter cannot widen the search."""
    return knn(vectors, query, 3 * k).where(where).orderBy("distance", "vec_id").limit(k)


def best_per_key(hits: DataFrame, key: str, score: str, tie: str, largest: bool = True) -> DataFrame:
    """The best hit for each key; ties by `tie`."""
    order = F.struct(-F.col(score) if largest else F.col(score), F.col(tie))
    others = [c for c in hits.columns if c != key]
    return hits.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("_r")).select(key, "_r.*")


def ranked(rows: DataFrame, by: list[str], key: str = "file") -> DataFrame:
    """rank (from 0) in each list, by score descending, then key."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), key)) - 1)


def rrf(lists: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """file, rrf: sum of weight / (k + rank + 1) over lists (list_idx, rank from 0, file), and a bonus for the best rank
    (0, or at most 2). A file that stands in a list twice counts twice."""
    rows = lists.join(F.broadcast(weights), "list_idx", "left") if weights is not None else lists.withColumn("weight", F.lit(1.0))
    w = F.coalesce("weight", F.lit(1.0))
    g = rows.groupBy("file").agg(F.sum(w / (RRF_K + F.col("rank") + 1)).alias("s"), F.min("rank").alias("top_rank"))
    bonus = F.when(F.col("top_rank") == 0, TOP_BONUS).when(F.col("top_rank") <= 2, NEAR_BONUS).otherwise(0.0)
    return g.select("file", (F.col("s") + bonus).alias("rrf"), "top_rank")


def rrf_trace(lists: DataFrame, weights: DataFrame) -> DataFrame:
    """file, contributions: array of (list_idx, rank from 1, weight, part), in list order."""
    rows = lists.join(F.broadcast(weights), "list_idx")
    part = F.col("weight") / (RRF_K + F.col("rank") + 1)
    return rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("list_idx", (F.col("rank") + 1).alias("rank"), "weight", part.alias("part")))).alias("contributions"))


def fusion_weights(lists: DataFrame) -> DataFrame:
    """The first two lists count twice."""
    return lists.select("list_idx").distinct().withColumn("weight", F.when(F.col("list_idx") < 2, 2.0).otherwise(1.0))


def blend(fused: DataFrame, rerank: DataFrame) -> DataFrame:
    """file, rank (from 1, by rrf), score = w / rank + (1 - w) * rerank score; w is 0.75 up to rank 3, 0.6 up to 10, then
    0.4. Files without a rerank score have 0. The window holds the fused candidates, of which there are at most as many
    as the fusion's limit."""
    r = fused.withColumn("rank", F.row_number().over(W.orderBy(F.desc("rrf"), "file")))
    w = F.when(F.col("rank") <= 3, 0.75).when(F.col("rank") <= 10, 0.6).otherwise(0.4)
    return r.join(rerank, "file", "left").select("file", "rank", (w / F.col("rank") + (1 - w) * F.coalesce("rerank_score", F.lit(0.0))).alias("score"))


def strong_signal(hits: DataFrame, least: float = 0.85, gap: float = 0.15) -> DataFrame:
    """One row: top1, top2, strong. Strong: the best score is high and clearly ahead of the second (0 if there is none)."""
    two = hits.orderBy(F.desc("score")).limit(2).agg(F.max("score").alias("top1"), F.when(F.count("*") > 1, F.min("score")).otherwise(0.0).alias("top2"))
    return two.withColumn("strong", F.coalesce((F.col("top1") >= least) & (F.col("top1") - F.col("top2") >= gap), F.lit(False)))


def overlap_score(text: Column, query: list[str], intent: list[str] = ()) -> Column:
    """Query terms of over 2 characters count 1, intent terms 0.5, where the text contains them."""
    low = F.lower(text)
    parts = [F.when(F.contains(low, F.lit(t.lower())), w).otherwise(0.0) for ts, w in ((query, 1.0), (intent, 0.5)) for t in ts if len(t) > 2 or w < 1]
    return sum(parts, F.lit(0.0))


def best_chunk(chunks: DataFrame, query: list[str], intent: list[str] = ()) -> DataFrame:
    """doc_id, seq, overlap of each document's best chunk; the first of equal ones."""
    c = chunks.withColumn("overlap", overlap_score(F.col("text"), query, intent))
    return best_per_key(c.select("doc_id", "seq", "overlap"), "doc_id", "overlap", "seq")


def retrieval_metrics(results: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """query_id, precision_at_k, recall, mrr, f1, hits_at_k. results: query_id, rank (from 1), file. expected: query_id,
    file. Two paths are one if either ends with the other; a path of many results counts once."""
    r = results.where(F.col("rank") <= k)
    same = (F.lower(r["file"]).endswith(F.lower(expected["file"]))) | (F.lower(expected["file"]).endswith(F.lower(r["file"])))
    hit = expected.join(r, (expected["query_id"] == r["query_id"]) & same).groupBy(expected["query_id"], expected["file"]).agg(F.min("rank").alias("rank"))
    per = hit.groupBy("query_id").agg(F.count("*").alias("hits"), F.min("rank").alias("best"))
    n = expected.groupBy("query_id").agg(F.count("*").alias("n"))
    m = n.join(per, "query_id", "left").select("query_id", "n", F.coalesce("hits", F.lit(0)).alias("hits"), "best")
    p, rec = F.col("hits") / F.least(F.lit(k), F.col("n")), F.col("hits") / F.col("n")
    return m.select("query_id", p.alias("precision_at_k"), rec.alias("recall"), F.coalesce(1 / F.col("best"), F.lit(0.0)).alias("mrr"), F.when(p + rec > 0, 2 * p * rec / (p + rec)).otherwise(0.0).alias("f1"), F.col("hits").alias("hits_at_k"))
