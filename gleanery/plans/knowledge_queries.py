"""Paths, names, links, registries, text functions and events over the test tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators import knowledge as K
from gleanery.operators import passages as P
from gleanery.operators import paths, registry, store
from gleanery.plans.store_queries import D, S, documents, snapshots, table
from gleanery.streaming import events as E

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# paths

@query("glob_match", D + " SELECT path FROM d WHERE regexp_matches(path, '^(en|de)/[^/]*7[.]md$')")
def glob_match(spark, sf):
    return documents(spark, sf).where(paths.matches_glob("{en,de}/*7.md")).select("path")


@query("suffix_match", D + " SELECT path FROM d WHERE lower(path) LIKE '%17.md' ORDER BY path")
def suffix_match(spark, sf):
    return documents(spark, sf).where(paths.ends_with("17.MD")).select("path").orderBy("path")


@query("prefix_list", D + " SELECT path, title, modified, CAST(length(doc) AS INTEGER) AS n_chars FROM d WHERE starts_with(path, 'fr/') AND active")
def prefix_list(spark, sf):
    d = documents(spark, sf).where("active").where(F.col("path").startswith("fr/"))
    return d.select("path", "title", "modified", F.length("doc").alias("n_chars")).orderBy("path")


@query("fuzzy_path", D + " SELECT path, CAST(levenshtein(lower(path), 'en/123.md') AS INTEGER) AS distance FROM d WHERE active AND levenshtein(lower(path), 'en/123.md') <= 3 ORDER BY distance, path LIMIT 5")
def fuzzy_path(spark, sf):
    return paths.similar(documents(spark, sf), "en/123.md")


@query("docid_lookup", D + " SELECT collection, path, hash[1:6] AS docid FROM d WHERE active AND starts_with(hash, (SELECT sha256(text)[1:6] FROM documents WHERE doc_id = 1)) ORDER BY collection, path LIMIT 1")
def docid_lookup(spark, sf):
    d = documents(spark, sf)
    h = d.where("doc_id = 1").first()["hash"]
    return paths.by_short_id(d, f'"#{h[:6]}"').select("collection", "path", paths.short_id(F.col("hash")).alias("docid"))


@query("get_document", D + " SELECT collection, path, 'suffix' AS how FROM d WHERE active AND lower(path) LIKE '%/42.md' ORDER BY collection, path LIMIT 1")
def get_document(spark, sf):
    return paths.get(documents(spark, sf), "/42.md:10").select("collection", "path", "how")


@query("multi_get", D + """, n AS (SELECT unnest(['en/0.md', '21.md', '150.md', 'nothing.md', '5.md']) AS name), h AS (SELECT name, min({'o': path <> name, 'p': path, 'b': octet_length(encode(doc))}) AS h FROM n JOIN d ON active AND (path = name OR suffix(path, '/' || name)) GROUP BY name)
 SELECT name, h.p AS path, CAST(h.b AS INTEGER) AS n_bytes, CASE WHEN h.b > 2000 THEN CAST(ceil(h.b / 1024) AS INTEGER) || ' KB' END AS skipped FROM n LEFT JOIN h USING (name)""")
def multi_get(spark, sf):
    names = spark.createDataFrame([(n,) for n in ("en/0.md", "21.md", "150.md", "nothing.md", "5.md")], "name string")
    return paths.multi_get(documents(spark, sf), names, 2000)


CTX = [("src1", "en/", "English notes"), ("src1", "en/1", "The ones"), ("src2", "", "All of it"), ("src2", "de/", "German notes")]
CTX_SQL = ", c AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in CTX) + ") t(collection, prefix, context))"


def context_table(spark) -> DataFrame:
    return spark.createDataFrame(CTX, "collection string, prefix string, context string")


@query("context_all_prefix", D + CTX_SQL + " SELECT d.collection, path, string_agg(context, chr(10) || chr(10) ORDER BY length(prefix), prefix) AS context FROM d LEFT JOIN c ON c.collection = d.collection AND starts_with(path, prefix) GROUP BY ALL")
def context_all_prefix(spark, sf):
    return paths.contexts(documents(spark, sf), context_table(spark))


@query("context_longest_prefix", D + CTX_SQL + " SELECT d.collection, path, coalesce(arg_max(context, length(prefix)), 'general') AS context FROM d LEFT JOIN c ON c.collection = d.collection AND starts_with(path, prefix) GROUP BY ALL")
def context_longest_prefix(spark, sf):
    return paths.longest_context(documents(spark, sf), context_table(spark), "general")


@query("context_missing", D + CTX_SQL + " SELECT DISTINCT collection, split_part(path, '/', 1) AS folder FROM d WHERE active AND (collection, split_part(path, '/', 1)) NOT IN (SELECT (collection, rtrim(prefix, '/')) FROM c)")
def context_missing(spark, sf):
    return paths.without_context(documents(spark, sf), context_table(spark))


@query("paired_sidecar", "WITH p AS (SELECT doc_id || '.pdf' AS path FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id || '.pdf.md' FROM documents WHERE doc_id % 3 = 0) SELECT path, suffix(path, '.md') AND left(path, -3) IN (SELECT path FROM p) AS hidden FROM p")
def paired_sidecar(spark, sf):
    d = table(spark, sf, "documents")
    p = d.where("doc_id % 2 = 0").select(F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path")).union(d.where("doc_id % 3 = 0").select(F.concat(F.col("doc_id").cast("string"), F.lit(".pdf.md"))))
    return paths.paired_sidecars(p, ["pdf", "docx"])


@query("line_slice", "SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS part FROM documents")
def line_slice(spark, sf):
    return table(spark, sf, "documents").select("doc_id", paths.lines(F.col("text"), 2, 3).alias("part"))


# names

SLUG = "trim(regexp_replace(lower(trim(p_name)), '[^\\p{L}\\p{N}]+', '-', 'g'), '-')"
#: Names of the parts with endings that the rules know.
ENDS = ["", "-management", "-list", "-status", "-page", "-service", "", "-control", "-planning", ""]
NAMES = f"n AS (SELECT p_partkey AS id, {SLUG} || ({ENDS!r})[p_partkey % 10 + 1] AS slug, 'src' || (p_partkey % 17) AS source, CASE WHEN p_partkey % 3 = 0 THEN 'entity' ELSE 'concept' END AS pool, ['tool', 'method', 'unknown', 'person', 'thing'][p_partkey % 5 + 1] AS type FROM part)"


def names(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    ends, kinds = F.array(*[F.lit(e) for e in ENDS]), F.array(*[F.lit(t) for t in ("tool", "method", "unknown", "person", "thing")])
    k = F.col("p_partkey").cast("int")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.concat(K.slug(F.col("p_name")), F.get(ends, k % 10)).alias("slug"),
        F.concat(F.lit("src"), (F.col("p_partkey") % 17).cast("string")).alias("source"),
        F.when(F.col("p_partkey") % 3 == 0, "entity").otherwise("concept").alias("pool"),
        F.get(kinds, k % 5).alias("type"),
    )


@query("slugs", f"WITH {NAMES} SELECT id, slug FROM n")
def slugs(spark, sf):
    return names(spark, sf).select("id", "slug")


@query("anti_pattern", f"WITH {NAMES} SELECT id, CASE WHEN suffix(slug, '-management') THEN 'function-management' WHEN suffix(slug, '-service') THEN 'function-service' WHEN suffix(slug, '-list') THEN 'label-list' WHEN regexp_matches(slug, '-({'|'.join(K.UI_ATOMS)})$') THEN 'ui-element' WHEN regexp_matches(slug, '-({'|'.join(K.DATA_FIELDS)})$') AND len(string_split(slug, '-')) <= 3 THEN 'data-field' END AS reason FROM n")
def anti_pattern(spark, sf):
    return names(spark, sf).select("id", K.anti_pattern(F.col("slug")).alias("reason"))


@query("slug_alias", f"WITH {NAMES} SELECT id, CASE WHEN id % 4 = 1 THEN 'merged-' || (id % 3) ELSE slug END AS slug FROM n")
def slug_alias(spark, sf):
    n = names(spark, sf).select("id", F.concat("slug", F.lit("-"), F.col("id").cast("string")).alias("slug"), F.col("slug").alias("plain"))
    a = n.where("id % 4 = 1").select(F.col("slug").alias("alias"), F.concat(F.lit("merged-"), (F.col("id") % 3).cast("string")).alias("target"))
    out = K.canonical(n, a)
    return out.select("id", F.when(F.col("id") % 4 == 1, F.col("slug")).otherwise(F.col("plain")).alias("slug"))


@query("type_validation", f"WITH {NAMES} SELECT id, CASE WHEN type IN ('tool', 'person') THEN 'entity' WHEN type = 'method' THEN 'concept' END AS pool, CASE WHEN type = 'unknown' THEN 'no hint' WHEN type = 'thing' THEN 'not in schema' END AS reason FROM n")
def type_validation(spark, sf):
    m = names(spark, sf).select("id", F.col("type").alias("type_hint"))
    return K.valid_types(m, ["tool", "person"], ["method"]).select("id", "pool", "reason")


@query("forced_category", f"WITH {NAMES}, g AS (SELECT CASE WHEN starts_with(slug, 's') THEN 'concept' ELSE pool END AS pool, slug, CASE WHEN starts_with(slug, 's') THEN 'pinned' ELSE type END AS type FROM n) SELECT pool, slug, min(type) AS type FROM g GROUP BY pool, slug")
def forced_category(spark, sf):
    n = names(spark, sf).select("slug", "pool", "type")
    pins = n.where(F.col("slug").startswith("s")).select("slug", F.lit("concept").alias("pool"), F.lit("pinned").alias("type")).distinct()
    return K.forced(n, pins)


@query("cross_pool_dedup", f"WITH {NAMES}, u AS (SELECT DISTINCT slug, pool FROM n) SELECT slug, pool FROM u WHERE pool = 'entity' OR slug NOT IN (SELECT slug FROM u WHERE pool = 'entity')")
def cross_pool_dedup(spark, sf):
    return K.cross_pool(names(spark, sf).select("slug", "pool").distinct())


INITIALS = "array_to_string(list_transform(string_split(slug, '-'), lambda w: w[1:1]), '')"


@query("acronym_dedup", f"WITH {NAMES}, f AS (SELECT DISTINCT slug FROM n WHERE contains(slug, '-')), s AS (SELECT DISTINCT {INITIALS} AS slug FROM f) SELECT s.slug, min(f.slug) AS full FROM s JOIN (SELECT slug, {INITIALS} AS i FROM f) f ON f.i = s.slug WHERE length(s.slug) <= 6 AND NOT contains(s.slug, '-') GROUP BY 1")
def acronym_dedup(spark, sf):
    n = names(spark, sf).select("slug").where("instr(slug, '-') > 0").distinct()
    return K.acronyms(n.union(n.select(K.initials(F.col("slug")))))


@query("cross_links", f"WITH {NAMES}, u AS (SELECT DISTINCT slug, pool, id % 50 AS cycle FROM n) SELECT a.cycle, a.slug, coalesce(string_agg(DISTINCT b.slug, '|' ORDER BY b.slug), '') AS links FROM u a LEFT JOIN u b ON a.cycle = b.cycle AND a.pool <> b.pool AND a.slug <> b.slug GROUP BY a.cycle, a.slug, a.pool")
def cross_links(spark, sf):
    n = names(spark, sf).select("slug", "pool", (F.col("id") % 50).alias("cycle")).distinct()
    return K.cross_links(n).select("cycle", "slug", F.array_join("links", "|").alias("links"))


@query("cooccurrence_groups", f"WITH {NAMES}, m AS (SELECT DISTINCT source, slug, split_part(slug, '-', 1) AS head FROM n) SELECT source, head, count(*) AS n FROM m GROUP BY ALL HAVING count(*) >= 3")
def cooccurrence_groups(spark, sf):
    return K.co_occurrence(names(spark, sf), length=0).select("source", "head", "n")


@query("suffix_cluster", f"WITH {NAMES}, s AS (SELECT unnest({K.CLUSTER_SUFFIXES!r}) AS suffix) SELECT s.suffix, count(DISTINCT source) AS n_sources, count(*) AS n_mentions, count(DISTINCT slug) AS n_slugs FROM n JOIN s ON suffix(slug, '-' || s.suffix) GROUP BY 1 HAVING count(DISTINCT source) >= 2")
def suffix_cluster(spark, sf):
    return K.suffix_clusters(names(spark, sf), K.CLUSTER_SUFFIXES)


@query("suggestion_confidence", f"WITH {NAMES}, g AS (SELECT source, count(*) AS m, count(DISTINCT slug) AS s, count(DISTINCT type) AS t FROM n GROUP BY source) SELECT source, round(0.4 * least(s / 5, 1.0) + 0.3 * CASE WHEN t <= 1 THEN 1 ELSE 0.5 END + 0.2 * least(m / 20, 1.0) + 0.1 * CASE WHEN source = 'src3' THEN 0 ELSE 1 END, 6) AS confidence FROM g WHERE source <> 'src5'")
def suggestion_confidence(spark, sf):
    g = names(spark, sf).groupBy("source").agg(F.count("*").alias("m"), F.count_distinct("slug").alias("s"), F.count_distinct("type").alias("t"))
    c = g.withColumns({"confidence": F.round(K.confidence(F.col("s"), F.col("t"), F.col("m"), F.col("source") == "src3"), 6), "signature": K.signature(F.col("source"), F.array("source"))})
    no = spark.createDataFrame([("src5",)], "s string").select(K.signature(F.col("s"), F.array("s")).alias("signature"))
    return K.suggestions(c, no, 0.0).select("source", "confidence")


# links

@query("wikilinks", "WITH l AS (SELECT page_id AS src, list_transform(regexp_extract_all(html, 'href=\"([^\"#]+)', 1), lambda t: regexp_replace(lower(string_split(trim(t), '/')[-1]), '[.]md$', '')) AS t FROM pages), e AS (SELECT src, unnest(t) AS dst, unnest(range(len(t))) AS pos FROM l) SELECT src, dst, CAST(pos AS INTEGER) AS pos FROM e WHERE dst <> ''")
def wikilinks(spark, sf):
    return links(spark, sf)


def links(spark, sf) -> DataFrame:
    return K.edges(table(spark, sf, "pages").select(F.col("page_id").alias("src"), "html"), "html", 'href="([^"#]+)')


EDGES = "WITH l AS (SELECT page_id AS src, list_transform(regexp_extract_all(html, 'href=\"([^\"#]+)', 1), lambda t: regexp_replace(lower(string_split(trim(t), '/')[-1]), '[.]md$', '')) AS t FROM pages), e AS (SELECT src, dst, pos FROM (SELECT src, unnest(t) AS dst, unnest(range(len(t))) AS pos FROM l) WHERE dst <> '')"


@query("backlinks", EDGES + " SELECT dst, count(DISTINCT src) AS n_sources FROM e GROUP BY dst")
def backlinks(spark, sf):
    l = links(spark, sf)
    return K.backlinks(l.select(F.col("src").cast("string").alias("src"), "dst"))


@query("broken_links", EDGES + ", p AS (SELECT DISTINCT dst FROM e WHERE src % 2 = 0) SELECT DISTINCT src, dst FROM e WHERE dst NOT IN (SELECT dst FROM p)")
def broken_links(spark, sf):
    l = links(spark, sf)
    return K.broken(l, l.where("src % 2 = 0").select(F.col("dst").alias("src")).distinct())


@query("unindexed_pages", EDGES + " SELECT DISTINCT dst AS src FROM e WHERE dst NOT IN (SELECT dst FROM e WHERE src % 3 = 0)")
def unindexed_pages(spark, sf):
    l = links(spark, sf)
    return K.unlinked(l.where("src % 3 = 0"), l.select(F.col("dst").alias("src")).distinct())


@query("one_hop", EDGES + " SELECT dst, count(*) AS n, CAST(min({'p': pos, 's': CAST(src AS VARCHAR)}).p AS INTEGER) AS first FROM e WHERE src < 20 AND dst NOT IN (SELECT CAST(page_id AS VARCHAR) FROM pages WHERE page_id < 20) GROUP BY dst ORDER BY n DESC, min({'p': pos, 's': CAST(src AS VARCHAR)}), dst LIMIT 5")
def one_hop(spark, sf):
    l = links(spark, sf).withColumn("src", F.col("src").cast("string"))
    base = table(spark, sf, "pages").where("page_id < 20").select(F.col("page_id").cast("string").alias("src"))
    return K.one_hop(l, base.select("src"))


@query("duplicate_names", EDGES + " SELECT dst, count(*) AS n FROM e GROUP BY dst HAVING count(*) > 1")
def duplicate_names(spark, sf):
    return links(spark, sf).groupBy("dst").agg(F.count("*").alias("n")).where("n > 1")


@query("provenance_dedup", "SELECT o_custkey AS page, o_orderstatus AS kind, o_orderpriority AS ref, min(o_orderkey) AS pos FROM orders GROUP BY ALL")
def provenance_dedup(spark, sf):
    return K.provenance(table(spark, sf, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("ref"), F.col("o_orderkey").alias("pos")))


# vectors and clusters

NEAR = 0.45


@query("similarity_edges", f"SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= {NEAR}")
def similarity_edges(spark, sf):
    return K.similarity_edges(table(spark, sf, "embeddings"), NEAR).select("a", "b", F.round("cosine", 6).alias("cosine"))


PAIRS = f"WITH RECURSIVE p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= {NEAR}), g AS (SELECT a, b FROM p UNION SELECT b, a FROM p), t AS (SELECT a AS node, a AS c FROM g UNION SELECT g.b, t.c FROM t JOIN g ON g.a = t.node), k AS (SELECT node, min(c) AS cluster FROM t GROUP BY node)"


def clusters(spark, sf) -> DataFrame:
    sc = spark.sparkContext
    if not (spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()):
        import tempfile

        sc.setCheckpointDir(tempfile.mkdtemp())  # tests only: clusters name a shared folder
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    return K.min_labels(K.similarity_edges(table(spark, sf, "embeddings"), NEAR))


@query("convergence_clusters", PAIRS + " SELECT node, cluster FROM k")
def convergence_clusters(spark, sf):
    return clusters(spark, sf)


@query("cluster_stats", PAIRS + ", m AS (SELECT vec_id AS node, label AS source FROM embeddings UNION SELECT vec_id, (vec_id % 4) + 100 FROM embeddings) SELECT cluster, count(DISTINCT k.node) AS n_members, count(DISTINCT source) AS n_sources, count(*) AS n_mentions FROM k JOIN m USING (node) GROUP BY cluster")
def cluster_stats(spark, sf):
    e = table(spark, sf, "embeddings")
    m = e.select(F.col("vec_id").alias("node"), F.col("label").cast("long").alias("source")).union(e.select("vec_id", (F.col("vec_id") % 4) + 100))
    return K.cluster_stats(clusters(spark, sf), m)


@query("mean_vectors", "SELECT label, i, round(avg(v), 6) AS m FROM (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding) AS v FROM embeddings) GROUP BY ALL")
def mean_vectors(spark, sf):
    m = K.mean_vectors(table(spark, sf, "embeddings"), "label")
    return m.select("label", F.posexplode("mean").alias("i", "m")).select("label", F.col("i").cast("long").alias("i"), F.round("m", 6).alias("m"))


# registry

@query("registry_reconcile", S + ", r AS (SELECT doc_id AS id, path, hash, doc_id % 17 = 0 AS tombstone FROM d WHERE doc_id % 7 <> 0), n AS (SELECT CASE WHEN split_part(path, '/', 2) LIKE '%4.md' THEN 'moved/' || path ELSE path END AS path, hash FROM s), a AS (SELECT hash, count(*) AS n, min(path) AS least FROM n GROUP BY hash), j AS (SELECT r.*, n.hash AS h, a.n, a.least FROM r LEFT JOIN n USING (path) LEFT JOIN a ON a.hash = r.hash), x AS (SELECT id, path, least, CASE WHEN tombstone AND n IS NOT NULL THEN 'restore' WHEN tombstone THEN 'gone' WHEN h IS NOT DISTINCT FROM hash AND n > 1 THEN 'duplicate' WHEN h IS NOT DISTINCT FROM hash THEN 'keep' WHEN n IS NOT NULL THEN 'move' WHEN h IS NOT NULL THEN 'modified' ELSE 'tombstone' END AS action FROM j) SELECT id, action, CASE WHEN action IN ('move', 'restore') THEN least ELSE path END AS new_path FROM x")
def registry_reconcile(spark, sf):
    d = documents(spark, sf)
    r = d.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("id"), "path", "hash", (F.col("doc_id") % 17 == 0).alias("tombstone"))
    scan = snapshots(spark, sf)[1].select(F.when(F.col("path").endswith("4.md"), F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")).alias("path"), "hash")
    return registry.reconcile(r, scan)


@query("reingest_decision", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'ingest' WHEN o_orderstatus = 'P' THEN 'restore' WHEN o_orderkey % 2 = 0 AND coalesce(CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 3 = 0 END, true) THEN 'skip' WHEN o_orderkey % 2 = 0 THEN 'protect' ELSE 'reingest' END AS decision FROM orders")
def reingest_decision(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select(k.alias("id"), (k % 11 != 0).alias("known"), (F.col("o_orderstatus") == "P").alias("tombstone"), (k % 2 == 0).alias("same_source"), F.when(k % 5 > 0, k % 3 == 0).alias("same_sidecar"))
    return registry.decide(o).select("id", "decision")


HISTORY = "h AS (SELECT doc_id AS id, CASE WHEN doc_id % 6 = 0 THEN '' ELSE 'now/' || doc_id END AS path, CASE WHEN doc_id % 4 = 0 THEN ['old/' || (doc_id + 1), ''] ELSE [] END AS history, doc_id % 10 = 9 AS tombstone FROM documents)"


def history(spark, sf) -> DataFrame:
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    txt = lambda a, c: F.concat(F.lit(a), c.cast("string"))
    return d.select(k.alias("id"), F.when(k % 6 == 0, "").otherwise(txt("now/", k)).alias("path"), F.when(k % 4 == 0, F.array(txt("old/", k + 1), F.lit(""))).otherwise(F.array().cast("array<string>")).alias("history"), (k % 10 == 9).alias("tombstone"))


@query("find_by_path", f"WITH {HISTORY}, w AS (SELECT 'old/' || doc_id AS path FROM documents UNION ALL SELECT 'now/' || doc_id FROM documents), c AS (SELECT id, path, 0 AS o FROM h UNION ALL SELECT id, unnest(history), 1 FROM h) SELECT path, min({{'o': o, 'i': id}}).i AS id FROM w JOIN c USING (path) GROUP BY path")
def find_by_path(spark, sf):
    k = F.col("doc_id").cast("string")
    d = table(spark, sf, "documents")
    return registry.by_path(history(spark, sf), d.select(F.concat(F.lit("old/"), k).alias("path")).union(d.select(F.concat(F.lit("now/"), k))))


@query("source_resolve", f"WITH {HISTORY}, x AS (SELECT *, coalesce(nullif(path, ''), list_filter(history, lambda p: p <> '')[-1]) AS p FROM h) SELECT id, CASE WHEN tombstone THEN 'deleted' WHEN p IS NULL THEN 'lost' ELSE 'live' END AS state, CASE WHEN NOT tombstone THEN p END AS path FROM x")
def source_resolve(spark, sf):
    return registry.resolve(history(spark, sf))


@query("registry_moves", f"WITH {HISTORY} SELECT id, CASE WHEN id % 5 = 2 THEN 'to/' || id ELSE path END AS path, array_to_string(CASE WHEN id % 5 = 2 THEN list_append(history, 'to/' || id) ELSE history END, '|') AS history, tombstone AND id % 5 <> 2 AS tombstone FROM h")
def registry_moves(spark, sf):
    h = history(spark, sf)
    m = h.where("id % 5 = 2").select("id", F.concat(F.lit("to/"), F.col("id").cast("string")).alias("to"))
    return registry.moved(h, m).withColumn("history", F.array_join("history", "|"))


@query("audit_rollup", "SELECT source AS folder, count(*) AS n_files, count(*) FILTER (doc_id % 3 <> 0) AS n_ingested, count(*) FILTER (doc_id % 3 = 0) AS n_missing, count(*) FILTER (lang = 'es') AS n_unsupported FROM documents GROUP BY 1")
def audit_rollup(spark, sf):
    d = documents(spark, sf)
    return registry.audit(d.select("path", F.col("collection").alias("folder"), (~F.col("path").startswith("es/")).alias("supported")), d.where("doc_id % 3 <> 0").select("path"))


@query("audit_diff", S + " SELECT path, CASE WHEN change = 'removed' THEN 'missing' WHEN change = 'new' THEN 'unknown' ELSE 'modified' END AS state FROM c WHERE change IN ('removed', 'new', 'updated')")
def audit_diff(spark, sf):
    return registry.diff(*snapshots(spark, sf))


@query("cost_rollup", "WITH l AS (SELECT CASE event_type WHEN 'click' THEN 'small' WHEN 'view' THEN 'medium' WHEN 'purchase' THEN 'large' ELSE event_type END AS provider, CAST(floor(value * 100) AS BIGINT) AS i, CAST(floor(value * 10) AS BIGINT) AS o FROM events), c AS (SELECT provider, i / 1e6 * CASE provider WHEN 'small' THEN 0.1 WHEN 'medium' THEN 0.5 ELSE 3.0 END + o / 1e6 * CASE provider WHEN 'small' THEN 0.4 WHEN 'medium' THEN 1.5 ELSE 15.0 END AS cost FROM l), g AS (SELECT provider, count(*) AS n, sum(cost) AS total FROM c GROUP BY 1) SELECT provider, n, round(total, 9) AS total, round(100 * total / sum(total) OVER (), 6) AS percent FROM g")
def cost_rollup(spark, sf):
    t = F.col("event_type")
    e = table(spark, sf, "events").select(F.when(t == "click", "small").when(t == "view", "medium").when(t == "purchase", "large").otherwise(t).alias("provider"), F.floor(F.col("value") * 100).alias("tokens_in"), F.floor(F.col("value") * 10).alias("tokens_out"))
    return registry.cost_rollup(e).select("provider", "n", F.round("total", 9).alias("total"), F.round("percent", 6).alias("percent"))


@query("determinism_stats", "SELECT event_type AS metric, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(100 * stddev_samp(value) / avg(value), 6) AS cv, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def determinism_stats(spark, sf):
    s = registry.run_statistics(table(spark, sf, "events").select(F.col("event_type").alias("metric"), "value"))
    return s.select("metric", "n", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "cv")], "low", "high")


@query("core_set", "SELECT 'user' || user_id AS name, count(DISTINCT event_type) AS n_runs, count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events) AS core FROM events GROUP BY 1")
def core_set(spark, sf):
    return registry.core_names(table(spark, sf, "events").select(F.col("event_type").alias("run"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("name")))


@query("hit_at_k", "SELECT CASE WHEN grouping(lang) = 1 THEN NULL ELSE lang END AS difficulty, count(*) AS n, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0 END), 6) AS hit1, round(avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0 END), 6) AS hit3, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0 END), 6) AS hit5 FROM (SELECT lang, CASE WHEN doc_id % 9 < 7 THEN doc_id % 9 + 1 END AS r FROM documents) GROUP BY ROLLUP (lang)")
def hit_at_k(spark, sf):
    r = table(spark, sf, "documents").select(F.col("lang").alias("difficulty"), F.when(F.col("doc_id") % 9 < 7, F.col("doc_id") % 9 + 1).alias("rank"))
    return registry.hit_at(r).select("difficulty", "n", *[F.round(c, 6).alias(c) for c in ("hit1", "hit3", "hit5")])


WORDS = "list_distinct(list_filter(string_split(lower(text), ' '), lambda w: w <> ''))"


@query("jaccard_metrics", f"WITH w AS (SELECT item_id, {WORDS} AS w FROM benchmark) SELECT a.item_id, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS jaccard, CAST(len(list_distinct(list_concat(a.w, b.w))) - len(list_intersect(a.w, b.w)) AS INTEGER) AS distance FROM w a JOIN w b ON b.item_id = a.item_id + 1")
def jaccard_metrics(spark, sf):
    w = table(spark, sf, "benchmark").select("item_id", F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda x: x != "")).alias("w"))
    j = w.join(w.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("v")), "item_id")
    return j.select("item_id", F.round(registry.jaccard(F.col("w"), F.col("v")), 6).alias("jaccard"), registry.set_distance(F.col("w"), F.col("v")).alias("distance"))


# text

TOK = "list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')"


@query("lang_hint", "SELECT doc_id, 'en' AS hint, CAST(ceil(length(text) / 4.0 * 1.3) AS BIGINT) AS tokens, CASE WHEN ceil(length(text) / 4.0 * 1.3) <= CAST(4096 * 0.8 AS INTEGER) - 2000 THEN 'FULL' ELSE 'SEGMENTED' END AS route FROM documents")
def lang_hint(spark, sf):
    """No Hangul in the test texts, so the divisor is 4 and the hint is en. The SQL rounds 3276.8 tokens to 3277."""
    d = table(spark, sf, "documents")
    t = T.tokens_estimate(F.col("text"))
    return d.select("doc_id", T.language_hint(F.col("text")).alias("hint"), t.alias("tokens"), T.route(t, 4096, whole=True).alias("route"))


@query("token_shares", f"WITH t AS (SELECT doc_id, {TOK} AS t FROM documents) SELECT doc_id, round(coalesce(len(list_filter(t, lambda w: length(w) >= 15)) / nullif(len(t), 0), 0), 6) AS long_share, round(coalesce(len(list_filter(t, lambda w: regexp_matches(w, '^[A-Z][A-Z0-9]{{1,5}}$'))) / nullif(len(t), 0), 0), 6) AS acronym_share FROM t")
def token_shares(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(T.long_token_share(F.col("text")), 6).alias("long_share"), F.round(T.acronym_share(F.col("text")), 6).alias("acronym_share"))


@query("quality_score", f"WITH t AS (SELECT doc_id, text, string_split(text, chr(10)) AS l, {TOK} AS t FROM documents), x AS (SELECT *, len(list_filter(l, lambda y: contains(y, '|'))) AS tables, len(list_filter(l, lambda y: contains(y, '|') AND length(y) - length(replace(y, '|', '')) < 2)) AS broken FROM t) SELECT doc_id, round(CASE WHEN length(text) < 100 THEN 0 ELSE greatest(1 - 0.3 * CASE WHEN tables > 0 THEN least(broken / tables, 1) ELSE 0 END - 0.4 * CASE WHEN len(list_filter(t, lambda w: length(w) >= 15)) / nullif(len(t), 0) > 0.3 THEN 1 ELSE 0 END, 0) END, 6) AS score FROM x")
def quality_score(spark, sf):
    """No headings and images in the test texts, so the SQL leaves these parts out."""
    return table(spark, sf, "documents").select("doc_id", F.round(T.quality_score(F.col("text")), 6).alias("score"))


@query("dewey_classify", "SELECT p_partkey AS id, CASE WHEN list_has_any(w, ['steel', 'tin', 'copper']) THEN '600' WHEN list_has_any(w, ['small', 'large']) THEN '300' ELSE '000' END AS class FROM (SELECT p_partkey, string_split(lower(p_type), ' ') AS w FROM part)")
def dewey_classify(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.classify(F.col("p_type"), {"600": ["steel", "tin", "copper"], "300": ["small", "large"]}).alias("class"))


@query("query_categories", "SELECT conv_id, turn, CASE WHEN regexp_matches(l, '^(how|howto)\\b') THEN 'how-to' WHEN regexp_matches(l, '^(what|who|when|where|which|why)\\b') THEN 'question' WHEN regexp_matches(l, '\\b(vs|versus|compare|difference)\\b') THEN 'comparison' WHEN regexp_matches(l, '\\b(error|exception|fail|bug|fix)\\b') THEN 'troubleshooting' WHEN regexp_matches(text, '[A-Za-z]+[._/][A-Za-z]+') THEN 'code' WHEN n <= 2 THEN 'keyword' WHEN n >= 12 THEN 'passage' ELSE 'topic' END AS category FROM (SELECT conv_id, turn, text, lower(trim(text)) AS l, len(regexp_split_to_array(trim(text), '[ \\t\\n]+')) AS n FROM conversations WHERE role = 'user')")
def query_categories(spark, sf):
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", T.query_category(F.col("text")).alias("category"))


@query("first_sentence", "SELECT doc_id, CASE WHEN s <> '' THEN s ELSE substring(t, 1, 100) END AS sentence FROM (SELECT doc_id, t, regexp_extract(t, '^([^.!?\\n]{4,159}[.!?])', 1) AS s FROM (SELECT doc_id, trim(text) AS t FROM documents))")
def first_sentence(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.first_sentence(F.col("text")).alias("sentence"))


@query("file_ids", "SELECT doc_id, 'sha256:' || sha256(text)[1:16] AS file_id, 'uri-hash:' || sha256(source)[1:16] AS uri_id FROM documents")
def file_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.file_id(F.col("text")).alias("file_id"), T.uri_id(F.col("source")).alias("uri_id"))


@query("strip_images", "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '!\\[([^\\]]*)\\]\\(data:[^)]*\\)', '[image]', 'g'), '!\\[\\]\\(https?://[^)]*\\)', '[image]', 'g'), '!\\[([^\\]]+)\\]\\(https?://[^)]*\\)', '[image: \\1]', 'g') AS t FROM (SELECT page_id, 'a ![](data:x) b ![alt ' || page_id || '](' || url || ') ![](' || url || ')' AS t FROM pages)")
def strip_images(spark, sf):
    t = F.concat(F.lit("a ![](data:x) b ![alt "), F.col("page_id").cast("string"), F.lit("]("), "url", F.lit(") ![]("), "url", F.lit(")"))
    return table(spark, sf, "pages").select("page_id", T.strip_images(t).alias("t"))


@query("extract_json", "SELECT event_id, props AS block FROM events")
def extract_json(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit("Answer:\n```json\n"), "props", F.lit("\n```\nDone.")).alias("t"))
    return e.select("event_id", T.json_block(F.col("t")).alias("block"))


@query("front_matter", "SELECT doc_id, source AS origin, lang AS language FROM documents")
def front_matter(spark, sf):
    d = table(spark, sf, "documents")
    t = F.concat(F.lit("---\norigin: "), "source", F.lit("\nlanguage: "), "lang", F.lit("\norigin: twice\n---\n"), "text")
    return d.select("doc_id", T.front_matter(t).alias("m")).select("doc_id", F.col("m")["origin"].alias("origin"), F.col("m")["language"].alias("language"))


@query("pii_scan", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS v FROM documents) GROUP BY doc_id")
def pii_scan(spark, sf):
    return P.personal_data(documents(spark, sf)).where("kind = 'email'").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("pii_mask_native", "SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '***', 'g') AS masked FROM documents")
def pii_mask_native(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "***").alias("masked"))


@query("pii_mask")
def pii_mask(spark, sf):
    return P.redact(documents(spark, sf))


@query("pii_hide")
def pii_hide(spark, sf):
    return P.redact(documents(spark, sf), "hide")


@query("pii_gate", "SELECT doc_id, CASE WHEN regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') OR regexp_matches(text, '(^|[^0-9])[0-9]{3}-[0-9]{2}-[0-9]{5}($|[^0-9])') OR regexp_matches(text, '(^|[^0-9])01[0-9]-[0-9]{3,4}-[0-9]{4}($|[^0-9])') THEN 'blocked' ELSE 'pass' END AS outcome FROM documents")
def pii_gate(spark, sf):
    return P.gate(documents(spark, sf)).select("doc_id", "outcome")


@query("chunk_documents")
def chunk_documents(spark, sf):
    return P.chunk_documents(documents(spark, sf))


@query("token_chunks")
def token_chunks(spark, sf):
    return P.chunk_by_tokens(documents(spark, sf))


@query("snippet")
def snippet(spark, sf):
    return P.snippets(documents(spark, sf), ["the", "thou"], ["with"])


@query("section_index")
def section_index(spark, sf):
    text = F.col("html")
    for level in range(1, 7):
        text = F.regexp_replace(text, f"(?is)<h{level}[^>]*>", "\n" + "#" * level + " ")
    p = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.regexp_replace(text, r"(?s)<[^>]*>", "\n").alias("doc"))
    return P.section_index(p)


# events

GAPS = "WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e)"


@query("debounce_sessions", GAPS + " SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS first, CAST(floor(epoch(max(ts))) AS BIGINT) + 600 AS last, count(*) AS n, CAST(count(DISTINCT event_type) AS INTEGER) AS n_items FROM g GROUP BY user_id, k")
def debounce_sessions(spark, sf):
    s = E.sessions(E.timed(table(spark, sf, "events")), "user_id", "10 minutes", "event_type")
    return s.select("user_id", F.unix_seconds("first").alias("first"), F.unix_seconds("last").alias("last"), "n", "n_items")


@query("rename_last_wins", GAPS + " SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS first, arg_max(event_type, {'t': ts, 'i': event_id}) AS value FROM g GROUP BY user_id, k")
def rename_last_wins(spark, sf):
    s = E.last_wins(E.timed(table(spark, sf, "events")), "user_id", "event_type", "10 minutes", "event_id")
    return s.select("user_id", F.unix_seconds("first").alias("first"), "value")


@query("startup_grace", "SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:10'")
def startup_grace(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return E.grace(e, "2024-01-05 00:00:00").agg(F.count("*").alias("n"))


@query("ttl_guard", """WITH r AS (SELECT user_id, ts, event_id, event_type <> 'click' AS is_event FROM events),
w AS (SELECT *, lag(is_event) OVER k AS before, lag(ts) OVER k AS ago FROM r WINDOW k AS (PARTITION BY user_id ORDER BY ts, is_event, CASE WHEN is_event THEN event_id END))
SELECT user_id, ts, event_id FROM w WHERE is_event AND NOT coalesce(NOT before AND ago + INTERVAL 1 HOUR >= ts, false)""")
def ttl_guard(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return E.guarded(e.where("event_type <> 'click'").select("user_id", "ts", "event_id"), e.where("event_type = 'click'").select("user_id", "ts"), "user_id", "1 hour")


@query("freshness", D + f" SELECT 'stale' AS state, count(*) FILTER (modified > {1704067200 + 50}) AS n_stale FROM d WHERE active")
def freshness(spark, sf):
    return E.freshness(documents(spark, sf), 1704067200 + 50)


@query("vector_upsert_latest", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def vector_upsert_latest(spark, sf):
    return store.latest(table(spark, sf, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_id").select("user_id", "event_type", "event_id")


@query("named_entities")
def named_entities(spark, sf):
    from gleanery.functions.passages import named_entities as find
    from gleanery.operators.passages import _each

    c = table(spark, sf, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.col("text").alias("doc"))
    return _each(c, lambda k, t: [(k, n) for n in find(t)], "doc_id long, name string")
