"""The engine's face: search, get, multi_get, status, update and audit over a document table, with pluggable models."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators import lexquery, passages, paths, search, store

#: text -> vector, over a column; and (candidates with file and text, query) -> candidates with rerank_score.
Embedder = Callable[[Column], Column]
Reranker = Callable[[DataFrame, list[str]], DataFrame]
DIMS = 64


def hashed_words(text: Column, dims: int = DIMS) -> Column:
    """The default embedder: counts of hashed words; stable over runs and machines."""
    slots = F.transform(search.terms(text), lambda t: F.pmod(F.xxhash64(t), F.lit(dims)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("float"))


def term_overlap(candidates: DataFrame, query: list[str]) -> DataFrame:
    """The default reranker: the share of query terms that a text contains."""
    n = max(1, len(query))
    return candidates.select("file", (search.overlap_score(F.col("text"), query) / n).alias("rerank_score"))


@dataclass
class Engine:
    """docs: doc_id, collection, path, title, hash, doc, modified, active."""

    spark: SparkSession
    docs: DataFrame
    embed: Embedder = hashed_words
    rerank: Reranker = term_overlap

    def live(self, collections: list[str] | None = None) -> DataFrame:
        d = self.docs.where("active")
        return d.where(F.col("collection").isin(collections)) if collections else d

    def lex(self, text: str, k: int, collections=None) -> DataFrame:
        units = lexquery.parse_lex(text)
        if units is None:
            return self.spark.createDataFrame([], "doc_id long, score double")
        rows = self.spark.createDataFrame([(i, u.kind, list(u.words), u.negated) for i, u in enumerate(units)], "unit int, kind string, words array<string>, negated boolean")
        return search.top(search.bm25(self.live(collections), rows).select("doc_id", "score"), k)

    def vec(self, text: str, k: int, collections=None) -> DataFrame:
        lexquery.check_semantic(text)
        q = self.spark.range(1).select(self.embed(F.lit(text)).alias("q")).first()["q"]
        v = self.live(collections).select("doc_id", self.embed(F.col("doc")).alias("embedding"))
        return search.knn(v, q, k, "doc_id").select("doc_id", (1 - F.col("distance")).alias("score"))

    def search(self, text: str, k: int = 10, collections=None, candidates: int = 40, min_score: float = 0.0) -> DataFrame:
        """path, title, score, line, snippet: a plain query is expanded, a typed one is run as it is; lists are fused, the
        best candidates reranked and blended."""
        q = lexquery.parse_document(text)
        if q is None or q.expand:
            q = lexquery.expand(q.expand if q else text)
        run = [(self.lex if kind == "lex" else self.vec)(t, max(20, 2 * k), collections).select(F.lit(i).alias("list_idx"), F.col("doc_id").alias("file"), "score") for i, (kind, t) in enumerate(q.searches)]
        lists = run[0]
        for l in run[1:]:
            lists = lists.unionByName(l)
        lists = search.ranked(lists, ["list_idx"])
        fused = search.rrf(lists, search.fusion_weights(lists)).orderBy(F.desc("rrf"), "file").limit(candidates)
        words = sorted({w for _, t in q.searches for w in lexquery.words_of(t)})
        body = self.docs.join(F.broadcast(fused.select(F.col("file").alias("doc_id"))), "doc_id")
        scores = self.rerank(body.select(F.col("doc_id").alias("file"), F.col("doc").alias("text")), words)
        best = search.top(search.blend(fused, scores).where(F.col("score") >= min_score), k, key="file")
        out = body.join(F.broadcast(best.select(F.col("file").alias("doc_id"), "score")), "doc_id")
        snip = passages.snippets(out.select("doc_id", "doc"), words, list(lexquery.words_of(q.intent or "")))
        return out.select("doc_id", "path", "title", "score").join(snip, "doc_id").orderBy(F.desc("score"), "doc_id")

    def get(self, name: str) -> DataFrame:
        return paths.get(self.docs, name)

    def multi_get(self, names: list[str], max_bytes: int = 10_240) -> DataFrame:
        if len(names) == 1 and any(c in names[0] for c in "*?{["):
            return self.live().where(paths.matches_glob(names[0])).select(F.col("path").alias("name"), "path", F.octet_length("doc").alias("n_bytes"))
        return paths.multi_get(self.docs, self.spark.createDataFrame([(n,) for n in names], "name string"), max_bytes)

    def status(self) -> DataFrame:
        return store.collection_stats(self.docs.select("collection").distinct(), self.docs)

    def update(self, scan: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(the store after the scan, what changed)."""
        old = self.docs if "created" in self.docs.columns else self.docs.withColumn("created", F.col("modified"))
        return store.upsert(old, scan), store.changes(old, scan)
