"""Store and retrieval queries over the test tables, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.stems import stems_sql
from gleanery.operators import containing, index, search, store
from gleanery.operators.index import Index
from gleanery.operators.lexquery import Unit
from gleanery.sources.adapters import DOCUMENTS_SQL, EPOCH, documents, table
from gleanery.sources.shared import shared_dir, stamp, written

D = f"WITH d AS ({DOCUMENTS_SQL})"
Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hash, seq: contents of the documents that have a vector of their id."""
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return documents(spark, sf_dir).join(ids, "doc_id", "left_semi").select("hash", F.lit(0).alias("seq")).distinct()


V = D + ", v AS (SELECT DISTINCT hash, 0 AS seq FROM d WHERE doc_id IN (SELECT vec_id FROM embeddings))"


@query("cas_dedup", D + " SELECT hash, min(doc_id) AS first_id, count(*) AS copies, CAST(min(octet_length(encode(doc))) AS INTEGER) AS n_bytes FROM d GROUP BY hash")
def cas_dedup(spark, sf):
    return store.contents(documents(spark, sf))


@query("orphan_content", D + " SELECT hash, min(doc_id) AS first_id, count(*) AS copies FROM d WHERE hash NOT IN (SELECT hash FROM d WHERE active) GROUP BY hash")
def orphan_content(spark, sf):
    d = documents(spark, sf)
    return store.orphans(store.contents(d), d).select("hash", "first_id", "copies")


@query("live_content", D + " SELECT DISTINCT hash FROM d WHERE active")
def live_content(spark, sf):
    d = documents(spark, sf)
    return store.referenced(store.contents(d), d).select("hash")


@query("cas_insert_ignore", D + " SELECT DISTINCT hash FROM d")
def cas_insert_ignore(spark, sf):
    d = documents(spark, sf)
    return store.insert_ignore(d.where("doc_id % 3 = 0").select("hash").distinct(), d.select("hash"))


@query("needs_embedding", V + " SELECT hash, min(path) AS path, CAST(min(octet_length(encode(doc))) AS INTEGER) AS n_bytes FROM d WHERE active AND hash NOT IN (SELECT hash FROM v WHERE seq = 0) GROUP BY hash")
def needs_embedding(spark, sf):
    return store.needs_embedding(documents(spark, sf), vectors(spark, sf))


@query("collection_stats", D + ", c AS (SELECT DISTINCT collection FROM d UNION SELECT 'empty') SELECT c.collection, count(doc_id) AS n_docs, count(*) FILTER (active) AS n_active, max(modified) AS last_modified FROM c LEFT JOIN d USING (collection) GROUP BY 1")
def collection_stats(spark, sf):
    d = documents(spark, sf)
    return store.collection_stats(d.select("collection").union(spark.sql("SELECT 'empty'")).distinct(), d)


@query("index_status", V + " SELECT count(*) AS total_active, count(DISTINCT collection) AS n_collections, max(modified) AS last_modified, (SELECT count(DISTINCT hash) FROM d WHERE active AND hash NOT IN (SELECT hash FROM v)) AS needs_embedding, (SELECT count(*) > 0 FROM v) AS has_vectors FROM d WHERE active")
def index_status(spark, sf):
    return store.index_status(documents(spark, sf), vectors(spark, sf))


NOW = EPOCH + 40 * 86400


@query("index_health", D + f" SELECT max(modified) AS last_modified, CAST(floor(({NOW} - max(modified)) / 86400) AS BIGINT) AS days_stale FROM d WHERE active")
def index_health(spark, sf):
    return store.index_health(documents(spark, sf), NOW)


def snapshots(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Two scans: the second lacks every fifth document and has other texts and titles here and there."""
    d = documents(spark, sf)
    old = d.where("doc_id % 7 <> 0").withColumn("created", F.col("modified"))
    new = d.where("doc_id % 5 <> 0").withColumns({"hash": F.when(F.col("doc_id") % 11 == 0, F.sha2(F.concat("doc", F.lit("x")), 256)).otherwise(F.col("hash")), "title": F.when(F.col("doc_id") % 13 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")), "modified": F.col("modified") + 1000})
    return old, new


S = D + """, o AS (SELECT *, modified AS created FROM d WHERE doc_id % 7 <> 0), s AS (SELECT collection, path, CASE WHEN doc_id % 11 = 0 THEN sha256(doc || 'x') ELSE hash END AS hash,
 CASE WHEN doc_id % 13 = 0 THEN title || '!' ELSE title END AS title, modified + 1000 AS modified FROM d WHERE doc_id % 5 <> 0),
 c AS (SELECT coalesce(s.collection, o.collection) AS collection, coalesce(s.path, o.path) AS path, CASE WHEN o.hash IS NULL THEN 'new' WHEN s.hash IS NULL THEN 'removed' WHEN o.hash <> s.hash THEN 'updated' WHEN o.title <> s.title THEN 'retitled' ELSE 'unchanged' END AS change,
 coalesce(s.title, o.title) AS title, coalesce(s.hash, o.hash) AS hash, coalesce(o.created, s.modified) AS created, coalesce(s.modified, o.modified) AS modified, s.hash IS NOT NULL AS active
 FROM s FULL JOIN o ON s.collection = o.collection AND s.path = o.path)"""


@query("change_detection", S + " SELECT collection, path, change FROM c")
def change_detection(spark, sf):
    return store.changes(*snapshots(spark, sf))


@query("change_summary", S + " SELECT count(*) FILTER (change = 'new') AS n_new, count(*) FILTER (change = 'updated') AS n_updated, count(*) FILTER (change = 'retitled') AS n_retitled, count(*) FILTER (change = 'unchanged') AS n_unchanged, count(*) FILTER (change = 'removed') AS n_removed FROM c")
def change_summary(spark, sf):
    return store.change_summary(store.changes(*snapshots(spark, sf)))


@query("doc_upsert", S + " SELECT collection, path, title, hash, created, modified, active FROM c")
def doc_upsert(spark, sf):
    return store.upsert(*snapshots(spark, sf))


@query("path_removed", S + " SELECT o.collection, o.path FROM o WHERE active AND NOT EXISTS (SELECT 1 FROM s WHERE s.collection = o.collection AND s.path = o.path)")
def path_removed(spark, sf):
    return store.removed(*snapshots(spark, sf))


@query("embedding_batches", D.replace("WITH", "WITH RECURSIVE") + """, o AS (SELECT collection, path, CAST(octet_length(encode(doc)) AS BIGINT) AS n_bytes, row_number() OVER (PARTITION BY collection ORDER BY path) AS i FROM d),
f AS (SELECT collection, path, n_bytes, i, 0 AS batch, 1 AS docs, n_bytes AS bytes FROM o WHERE i = 1
 UNION ALL SELECT o.collection, o.path, o.n_bytes, o.i, CASE WHEN f.docs >= 16 OR f.bytes + o.n_bytes > 20000 THEN f.batch + 1 ELSE f.batch END,
 CASE WHEN f.docs >= 16 OR f.bytes + o.n_bytes > 20000 THEN 1 ELSE f.docs + 1 END, CASE WHEN f.docs >= 16 OR f.bytes + o.n_bytes > 20000 THEN o.n_bytes ELSE f.bytes + o.n_bytes END
 FROM f JOIN o ON o.collection = f.collection AND o.i = f.i + 1)
SELECT collection, path, n_bytes, CAST(batch AS BIGINT) AS batch FROM f""")
def embedding_batches(spark, sf):
    d = documents(spark, sf)
    return store.batches(d.select("collection", "path", F.octet_length("doc").alias("n_bytes")), 16, 20_000)


@query("lru_prune", "SELECT event_id AS key, epoch_us(ts) AS created FROM events ORDER BY created DESC, key LIMIT 1000")
def lru_prune(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("created"))
    return store.lru(e, 1000)


@query("duplicate_titles", D + " SELECT collection, path, count(*) OVER (PARTITION BY collection, title) AS n_same_title FROM d")
def duplicate_titles(spark, sf):
    return store.duplicate_titles(documents(spark, sf))


# retrieval

FOLD = f"translate(lower(%s), '{search.ACCENTS}', '{search.PLAIN}')"
TERMS = "list_filter(regexp_split_to_array(" + FOLD + ", '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"
FIELDS = (("path", "path", 1.5), ("title", "title", 4.0), ("body", "doc", 1.0))
POST = D + ", p AS (" + " UNION ALL ".join(f"SELECT doc_id, '{f}' AS field, {w} AS w, unnest(range(len(t))) AS pos, unnest(t) AS term FROM (SELECT doc_id, {TERMS % c} AS t FROM d)" for f, c, w in FIELDS) + "), dl AS (SELECT doc_id, count(*) AS dl FROM p GROUP BY 1), n AS (SELECT (SELECT count(*) FROM d) AS n, (SELECT count(*) FROM p) / (SELECT count(*) FROM d) AS avgdl)"
#: Two common syllable words of the test texts, a prefix and a phrase.
UNITS = [(0, "term", ["the"], False), (1, "prefix", ["thou"], False)]
PHRASE = [(0, "phrase", ["of", "the"], False), (1, "prefix", ["an"], False), (2, "term", ["was"], True)]
SCHEMA = "unit int, kind string, words array<string>, negated boolean"


def bm25_sql(tf: str, bad: str = "", tail: str = "") -> str:
    return POST + f""", m AS ({tf}), f AS (SELECT unit, count(*) AS c FROM m GROUP BY unit),
 x AS (SELECT m.doc_id, sum(greatest(CASE WHEN ln((n.n - f.c + 0.5) / (f.c + 0.5)) <= 0 THEN 1e-6 ELSE ln((n.n - f.c + 0.5) / (f.c + 0.5)) END, 0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * coalesce(dl, 0) / avgdl))) AS s, count(*) AS k
 FROM m JOIN f USING (unit) JOIN dl USING (doc_id), n GROUP BY m.doc_id)
 SELECT doc_id, round(s / (1 + s), 6) AS score FROM x WHERE k = (SELECT count(DISTINCT unit) FROM m) {bad} {tail}"""


TF2 = "SELECT 0 AS unit, doc_id, sum(w) AS tf FROM p WHERE term = 'the' GROUP BY doc_id UNION ALL SELECT 1, doc_id, sum(w) FROM p WHERE starts_with(term, 'thou') GROUP BY doc_id"


_INDEXES: dict[tuple, Index] = {}


def kept_index(spark: SparkSession, sf_dir: str, analyser: str = "simple") -> Index:
    """The index over documents: built by the first query of an application that needs it, and read by the others as long as
    the table's files are the same."""
    key = (spark.sparkContext.applicationId, sf_dir, analyser, stamp(spark, f"{sf_dir}/documents.parquet"))
    if key not in _INDEXES:
        _INDEXES[key] = Index.build(documents(spark, sf_dir), shared_dir(spark, "index"), analyser=analyser)
    return _INDEXES[key]


def units_of(rows: list[tuple]) -> list[Unit]:
    return [Unit(kind, tuple(words), negated) for _, kind, words, negated in rows]


def scored(spark, sf, units):
    return kept_index(spark, sf).bm25(units_of(units)).select("doc_id", F.round("score", 6).alias("score"))


@query("bm25_search", bm25_sql(TF2, "", "ORDER BY score DESC, doc_id LIMIT 10"))
def bm25_search(spark, sf):
    return search.top(scored(spark, sf, UNITS), 10)


@query("bm25_all", bm25_sql(TF2))
def bm25_all(spark, sf):
    return scored(spark, sf, UNITS)


@query("lex_phrase_not_prefix", bm25_sql("SELECT 0 AS unit, a.doc_id, sum(a.w) AS tf FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.field = b.field AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY a.doc_id UNION ALL SELECT 1, doc_id, sum(w) FROM p WHERE starts_with(term, 'an') GROUP BY doc_id", "AND doc_id NOT IN (SELECT doc_id FROM p WHERE term = 'was')"))
def lex_phrase_not_prefix(spark, sf):
    return scored(spark, sf, PHRASE)


@query("bm25_collection_overfetch", f"SELECT doc_id, score FROM (SELECT * FROM ({bm25_sql(TF2, '', 'ORDER BY score DESC, doc_id LIMIT 100')})) JOIN (SELECT doc_id, source FROM documents) USING (doc_id) WHERE source = 'src1' ORDER BY score DESC, doc_id LIMIT 10")
def bm25_collection_overfetch(spark, sf):
    """The filter comes after ten times the wanted results have been cut off."""
    hits = search.top(scored(spark, sf, UNITS), 100)
    return search.top(hits.join(documents(spark, sf).where("collection = 'src1'").select("doc_id"), "doc_id", "left_semi"), 10)


AFTER = " FROM documents WHERE doc_id % 11 <> 0"


def changed_index(spark, sf) -> Index:
    """An index over an earlier state of the documents, brought up to date: ids divisible by 7 come in, texts of ids with
    remainder 1 by 5 had their first 200 characters only, ids divisible by 11 go."""
    d = documents(spark, sf)
    short = F.col("doc_id") % 5 == 1
    old = d.where("doc_id % 7 <> 0").withColumn("doc", F.when(short, F.substring("doc", 1, 200)).otherwise(F.col("doc")))
    op = F.when(F.col("doc_id") % 11 == 0, "delete").when(F.col("doc_id") % 7 == 0, "insert").when(short, "update")
    return Index.build(old, shared_dir(spark, "index")).delta(d, d.select("doc_id", op.alias("op")).where("op IS NOT NULL"))


@query("index_after_delta", bm25_sql(TF2).replace(" FROM documents", AFTER))
def index_after_delta(spark, sf):
    """A search of an index after a delta is one of an index built anew."""
    return changed_index(spark, sf).bm25(units_of(UNITS)).select("doc_id", F.round("score", 6).alias("score"))


@query("index_after_merge", SQL["lex_phrase_not_prefix"].replace(" FROM documents", AFTER))
def index_after_merge(spark, sf):
    """The same after its segments were merged, with a phrase and a negated word."""
    return changed_index(spark, sf).merged().bm25(units_of(PHRASE)).select("doc_id", F.round("score", 6).alias("score"))


#: Inflected forms; their stems are found in other forms of the words too.
STEMMED = [(0, "term", ["ening"], False), (1, "phrase", ["of", "ered"], False)]
STEM_SQL = POST.replace(" p AS (", " raw AS (", 1).replace(", dl AS (", ", " + stems_sql("raw") + ", p AS (SELECT doc_id, field, w, pos, coalesce(stem, term) AS term FROM raw LEFT JOIN w7 USING (term)), dl AS (")


@query("bm25_porter", bm25_sql("SELECT 0 AS unit, doc_id, sum(p.w) AS tf FROM p WHERE term IN (SELECT stem FROM q WHERE k = 0) GROUP BY doc_id UNION ALL SELECT 1, a.doc_id, sum(a.w) AS tf FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.field = b.field AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term IN (SELECT stem FROM q WHERE k = 1) GROUP BY a.doc_id").replace(POST, STEM_SQL + ", q AS (SELECT 0 AS k, stem FROM w7 WHERE term = 'ening' UNION ALL SELECT 1, stem FROM w7 WHERE term = 'ered')"))
def bm25_porter(spark, sf):
    """Search with stems: a kept index with the Porter analyser, and a query whose words are stemmed too."""
    return kept_index(spark, sf, "porter").bm25(units_of(STEMMED)).select("doc_id", F.round("score", 6).alias("score"))


COS = "round(1 - coalesce(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 0), 6)"
ONE = "(SELECT embedding FROM embeddings WHERE vec_id = 0) q"


def first_vector(spark, sf, k: int = 0) -> list[float]:
    return table(spark, sf, "embeddings").where(F.col("vec_id") == k).first()["embedding"]


@query("vector_knn", f"SELECT vec_id, {COS} AS distance FROM embeddings e, {ONE} ORDER BY distance, vec_id LIMIT 10")
def vector_knn(spark, sf):
    return search.knn(table(spark, sf, "embeddings"), first_vector(spark, sf), 10).select("vec_id", "distance")


@query("vector_knn_postfilter", f"SELECT vec_id, distance FROM (SELECT vec_id, label, {COS} AS distance FROM embeddings e, {ONE} ORDER BY distance, vec_id LIMIT 30) WHERE label = 1 ORDER BY distance, vec_id LIMIT 10")
def vector_knn_postfilter(spark, sf):
    return search.knn_post_filter(table(spark, sf, "embeddings"), first_vector(spark, sf), 10, F.col("label") == 1).select("vec_id", "distance")


@query("vector_best_per_doc", f"SELECT doc, vec_id, distance FROM (SELECT vec_id // 5 AS doc, vec_id, distance, row_number() OVER (PARTITION BY vec_id // 5 ORDER BY distance, vec_id) AS r FROM (SELECT vec_id, {COS} AS distance FROM embeddings e, {ONE} ORDER BY distance, vec_id LIMIT 60)) WHERE r = 1")
def vector_best_per_doc(spark, sf):
    """Five vectors a document: the nearest counts."""
    hits = search.knn(table(spark, sf, "embeddings"), first_vector(spark, sf), 60).select(F.floor(F.col("vec_id") / 5).alias("doc"), "vec_id", "distance")
    return search.best_per_key(hits, "doc", "distance", "vec_id", largest=False)


def two_lists(spark, sf) -> DataFrame:
    """list_idx, rank, file: the nearest vectors of two query vectors, and a third list of a lexical search."""
    e = table(spark, sf, "embeddings")
    parts = [search.knn(e, first_vector(spark, sf, k), 20).select(F.lit(k).alias("list_idx"), (1 - F.col("distance")).alias("score"), F.col("vec_id").alias("file")) for k in (0, 1)]
    lex = search.top(scored(spark, sf, UNITS), 20).select(F.lit(2).alias("list_idx"), "score", F.col("doc_id").alias("file"))
    return search.ranked(parts[0].unionByName(parts[1]).unionByName(lex), ["list_idx"])


LISTS = POST.replace("WITH d AS", "WITH d AS", 1) + f""", m AS ({TF2}), f AS (SELECT unit, count(*) AS c FROM m GROUP BY unit),
 x AS (SELECT m.doc_id, sum(CASE WHEN ln((n.n - f.c + 0.5) / (f.c + 0.5)) <= 0 THEN 1e-6 ELSE ln((n.n - f.c + 0.5) / (f.c + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS s, count(*) AS k FROM m JOIN f USING (unit) JOIN dl USING (doc_id), n GROUP BY m.doc_id),
 l AS (SELECT 2 AS list_idx, round(s / (1 + s), 6) AS score, doc_id AS file FROM x WHERE k = 2 ORDER BY score DESC, file LIMIT 20),
 a AS (SELECT 0 AS list_idx, 1 - {COS} AS score, vec_id AS file FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {COS}, vec_id LIMIT 20),
 b AS (SELECT 1 AS list_idx, 1 - {COS} AS score, vec_id AS file FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q ORDER BY {COS}, vec_id LIMIT 20),
 r AS (SELECT *, row_number() OVER (PARTITION BY list_idx ORDER BY score DESC, file) - 1 AS rank, CASE WHEN list_idx < 2 THEN 2.0 ELSE 1.0 END AS weight FROM (FROM a UNION ALL FROM b UNION ALL FROM l)),
 g AS (SELECT file, sum(weight / (60 + rank + 1)) + CASE WHEN min(rank) = 0 THEN 0.05 WHEN min(rank) <= 2 THEN 0.02 ELSE 0 END AS rrf, min(rank) AS top_rank FROM r GROUP BY file)"""


@query("rrf_fusion", LISTS + " SELECT file, round(rrf, 9) AS rrf, CAST(top_rank AS INTEGER) AS top_rank FROM g")
def rrf_fusion(spark, sf):
    l = two_lists(spark, sf)
    return search.rrf(l, search.fusion_weights(l)).select("file", F.round("rrf", 9).alias("rrf"), "top_rank")


@query("rrf_trace", LISTS + " SELECT file, string_agg(list_idx || ':' || (rank + 1) || ':' || printf('%.6f', round(weight / (61 + rank), 6)), ',' ORDER BY list_idx, rank) AS trace FROM r GROUP BY file")
def rrf_trace(spark, sf):
    l = two_lists(spark, sf)
    t = search.rrf_trace(l, search.fusion_weights(l))
    return t.select("file", F.array_join(F.transform("contributions", lambda c: F.format_string("%d:%d:%.6f", c.list_idx, c["rank"], F.round(c.part, 6))), ",").alias("trace"))


@query("blend_rerank", LISTS + ", h AS (SELECT *, row_number() OVER (ORDER BY rrf DESC, file) AS rank FROM g) SELECT file, CAST(rank AS INTEGER) AS rank, round(w / rank + (1 - w) * rs, 9) AS score FROM (SELECT file, rank, CASE WHEN rank <= 3 THEN 0.75 WHEN rank <= 10 THEN 0.6 ELSE 0.4 END AS w, CASE WHEN file % 3 = 0 THEN 0 ELSE (file % 7) / 7 END AS rs FROM h)")
def blend_rerank(spark, sf):
    l = two_lists(spark, sf)
    fused = search.rrf(l, search.fusion_weights(l))
    rerank = fused.where("file % 3 <> 0").select("file", ((F.col("file") % 7) / 7).alias("rerank_score"))
    return search.blend(fused, rerank).select("file", "rank", F.round("score", 9).alias("score"))


@query("hybrid_search", LISTS + ", h AS (SELECT *, row_number() OVER (ORDER BY rrf DESC, file) AS rank FROM g ORDER BY rrf DESC, file LIMIT 40) SELECT file, round(CASE WHEN rank <= 3 THEN 0.75 WHEN rank <= 10 THEN 0.6 ELSE 0.4 END / rank + CASE WHEN rank <= 3 THEN 0.25 WHEN rank <= 10 THEN 0.4 ELSE 0.6 END * (CASE WHEN contains(lower(text), 'the') THEN 0.5 ELSE 0 END + CASE WHEN contains(lower(text), 'thou') THEN 0.5 ELSE 0 END), 6) AS score FROM h JOIN documents ON doc_id = file ORDER BY score DESC, file LIMIT 10")
def hybrid_search(spark, sf):
    """Lexical and vector lists, fusion, 40 candidates, rerank by term overlap, blend, top 10."""
    l = two_lists(spark, sf)
    cand = search.rrf(l, search.fusion_weights(l)).orderBy(F.desc("rrf"), "file").limit(40)
    d = documents(spark, sf)
    rerank = d.join(F.broadcast(cand.select(F.col("file").alias("doc_id"))), "doc_id").select(F.col("doc_id").alias("file"), (search.overlap_score(F.col("doc"), ["the", "thou"]) / 2).alias("rerank_score"))
    blended = search.blend(cand, rerank).join(rerank.select("file"), "file", "left_semi")
    return search.top(blended.select("file", F.round("score", 6).alias("score")), 10, key="file")


@query("vector_multi_query", f"SELECT vec_id, max(score) AS score FROM (SELECT vec_id, round(1 - {COS}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id IN (0, 1, 2)) q) GROUP BY vec_id HAVING max(score) >= 0.3")
def vector_multi_query(spark, sf):
    """The best score over three query vectors, at least 0.3."""
    e = table(spark, sf, "embeddings")
    q = F.broadcast(e.where("vec_id IN (0, 1, 2)").select(F.col("embedding").alias("q")))
    s = e.crossJoin(q).select("vec_id", F.round(1 - F.round(1 - search.cosine(F.col("embedding"), F.col("q")), 6), 6).alias("score"))  # three query rows
    return s.groupBy("vec_id").agg(F.max("score").alias("score")).where("score >= 0.3")


@query("strong_signal", bm25_sql(TF2).replace("SELECT doc_id, round(s / (1 + s), 6) AS score FROM x", "SELECT max(sc) AS top1, min(sc) AS top2, max(sc) >= 0.85 AND max(sc) - min(sc) >= 0.15 AS strong FROM (SELECT round(s / (1 + s), 6) AS sc FROM x").rstrip() + " ORDER BY sc DESC LIMIT 2)")
def strong_signal(spark, sf):
    return search.strong_signal(scored(spark, sf, UNITS))


@query("best_chunk_fixed", "WITH c AS (SELECT doc_id, unnest(range(0, greatest(length(text), 1), 500)) AS s, text FROM documents), k AS (SELECT doc_id, CAST(s / 500 AS INTEGER) AS seq, lower(substring(text, s + 1, 500)) AS t FROM c), o AS (SELECT doc_id, seq, CAST(CASE WHEN contains(t, 'thou') THEN 1.0 ELSE 0 END + CASE WHEN contains(t, 'with') THEN 1.0 ELSE 0 END + CASE WHEN contains(t, 'from') THEN 0.5 ELSE 0 END AS DOUBLE) AS overlap FROM k) SELECT doc_id, seq, overlap FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY overlap DESC, seq) AS r FROM o) WHERE r = 1")
def best_chunk_fixed(spark, sf):
    """Chunks of 500 characters; the one with most query and intent terms."""
    d = documents(spark, sf)
    at = F.sequence(F.lit(0), F.greatest(F.length("doc"), F.lit(1)) - 1, F.lit(500))
    c = d.select("doc_id", "doc", F.posexplode(at).alias("seq", "s")).select("doc_id", "seq", F.substring(F.col("doc"), F.col("s") + 1, F.lit(500)).alias("text"))
    return search.best_chunk(c, ["thou", "with"], ["from"]).select("doc_id", "seq", "overlap")


#: Words 3 to 7 of each benchmark passage are its query.
ASK = f"SELECT item_id AS query_id, list_distinct(({TERMS % 'text'})[3:7]) AS words FROM benchmark"


@query("search_many", POST + f""", q AS ({ASK}), w AS (SELECT query_id, len(words) AS need, unnest(words) AS term FROM q), m AS (SELECT term, doc_id, sum(w) AS tf FROM p WHERE term IN (SELECT term FROM w) GROUP BY ALL),
f AS (SELECT term, count(*) AS c FROM m GROUP BY term), x AS (SELECT query_id, doc_id, need, count(*) AS k, sum(CASE WHEN ln((n.n - c + 0.5) / (c + 0.5)) <= 0 THEN 1e-6 ELSE ln((n.n - c + 0.5) / (c + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS s
 FROM w JOIN m USING (term) JOIN f USING (term) JOIN dl USING (doc_id), n GROUP BY ALL),
h AS (SELECT query_id, doc_id, round(s / (1 + s), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s / (1 + s), 6) DESC, doc_id) AS rank FROM x WHERE k = need)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM h WHERE rank <= 10""")
def search_many(spark, sf):
    """One pass of the kept index for a table of queries."""
    return index.many(kept_index(spark, sf), asked(spark, sf), 10).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def asked(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.slice(search.terms(F.col("text")), 3, 5).alias("words"))


def passages_in(spark, sf) -> DataFrame:
    """text_id, pattern_id: documents and the benchmark passages that they contain."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("pattern_id"), F.col("text").alias("pattern"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return containing.containing(d, b, containing.all_words, containing.inner_words)


@query("passages_contained", "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def passages_contained(spark, sf):
    return passages_in(spark, sf).select(F.col("text_id").alias("doc_id"), F.col("pattern_id").alias("item_id"))


@query("retrieval_metrics", SQL["search_many"].split("SELECT query_id, CAST(rank")[0] + """, e AS (SELECT DISTINCT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
 mm AS (SELECT e.query_id, count(*) AS n, count(h.rank) AS hits, min(h.rank) AS best FROM e LEFT JOIN h ON h.query_id = e.query_id AND h.doc_id = e.doc_id AND h.rank <= 10 GROUP BY 1),
 pr AS (SELECT *, hits / least(10, n) AS p, hits / n AS rec FROM mm)
 SELECT query_id, round(p, 6) AS precision_at_k, round(rec, 6) AS recall, round(coalesce(1 / best, 0), 6) AS mrr, round(CASE WHEN p + rec > 0 THEN 2 * p * rec / (p + rec) ELSE 0 END, 6) AS f1, hits AS hits_at_k FROM pr""")
def retrieval_metrics(spark, sf):
    """Documents that contain a passage are expected for the query of some of its words; results are a search's."""
    name = F.format_string("doc-%08d.md", "doc_id")
    expected = passages_in(spark, sf).select(F.col("pattern_id").alias("query_id"), F.col("text_id").alias("doc_id")).distinct().select("query_id", name.alias("file"))
    expected = written(expected, "expected-files")
    results = index.many(kept_index(spark, sf), asked(spark, sf), 10).select("query_id", "rank", F.concat(F.lit("notes/"), name).alias("file"))
    m = search.retrieval_metrics(results, expected, 10)
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in ("precision_at_k", "recall", "mrr", "f1")], "hits_at_k")
