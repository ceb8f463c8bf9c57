"""Queries of the training-data operators over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its whole text after line dedup."""
    from gleanery.llm.line_dedup import dedup

    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every page's url. The list: canonical URLs of the pages whose id is divisible by 50."""
    from gleanery.llm.url_filter import canonical, judge, with_parts

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = with_parts(pages.where("page_id % 50 = 0")).select(canonical(F.col("_host"), F.col("_path")).alias("canon"))
    return judge(pages, listed).select("page_id", "host", "path", "rule", "verdict", "listed")


SQL_URL = """
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^([^/?#]*)', 1) AS raw FROM a),
c AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substring(rest, length(raw) + 1), '^([^?#]*)', 1) AS path FROM b),
d AS (SELECT *, CASE WHEN host = '' THEN '' ELSE regexp_replace(regexp_replace(host, ':[0-9]*$', ''), '^(www|m)[.]', '')
  || regexp_replace(regexp_replace(path, '[.]html$', ''), '/+$', '') END AS canon FROM c),
e AS (SELECT DISTINCT canon FROM d WHERE page_id % 50 = 0 AND canon <> ''),
f AS (SELECT *, canon IN (SELECT canon FROM e) AS listed,
  CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
       WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
       WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
       WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM d)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM f
"""


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the content-addressed store of all documents and reads each document's ids back from its files."""
    from gleanery.llm.token_store import store, verify

    path = store(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end=2)
    return verify(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32", "verified")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document; labels are learned only where crc32(doc_id) mod 5 is not 0."""
    from gleanery.llm.quality_gbdt import fit, remainder, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = remainder(F.col("doc_id"), 5) == 0
    out = score(docs, fit(docs, table(spark, sf_dir, "labels"), ~held))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    from gleanery.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL_LEAKS = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
m AS (SELECT unnest([[0, 1, 3, 4, 7], [0, 2, 3, 5, 7], [0, 1, 2, 4, 6]]) AS o),
ds AS (SELECT doc_id, o, p, [w[p + 1 + o[1]], w[p + 1 + o[2]], w[p + 1 + o[3]], w[p + 1 + o[4]], w[p + 1 + o[5]]] AS k
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - 7)) AS p FROM d), m),
s AS (SELECT item_id, o, p, [w[p + 1 + o[1]], w[p + 1 + o[2]], w[p + 1 + o[3]], w[p + 1 + o[4]], w[p + 1 + o[5]]] AS k
  FROM (SELECT item_id, w, unnest(range(0, len(w) - 7)) AS p FROM i), m),
h AS (SELECT DISTINCT doc_id, item_id, ds.p - s.p AS start FROM ds JOIN s USING (o, k)),
c AS (SELECT h.*, len(i.w) AS item_words, (SELECT count(*) FROM range(0, len(i.w)) t(x) WHERE h.start + x >= 0 AND d.w[h.start + x + 1] = i.w[x + 1]) AS matched
  FROM h JOIN d USING (doc_id) JOIN i USING (item_id)),
v AS (SELECT doc_id, item_id, p AS start, len(i.w) AS item_words, len(i.w) AS matched FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS p FROM d) t
  JOIN i ON len(i.w) BETWEEN 1 AND 7 AND t.w[p + 1:p + len(i.w)] = i.w),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, start) AS n FROM (SELECT doc_id, item_id, start, item_words, matched FROM c
  WHERE matched >= 8 AND matched >= 0.5 * item_words UNION ALL SELECT * FROM v))
SELECT doc_id, item_id, CAST(matched AS INTEGER) AS matched, CAST(item_words AS INTEGER) AS item_words, CAST(start AS INTEGER) AS start FROM r WHERE n = 1
"""


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document; labels are learned only where crc32(doc_id) mod 3 is not 1."""
    from gleanery.llm.quality_gbdt import remainder
    from gleanery.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = remainder(F.col("doc_id"), 3) == 1
    out = score(docs, fit(docs, table(spark, sf_dir, "labels"), ~held))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_bm25_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 10 of all documents for the whole text of every document whose id is divisible by 50."""
    from gleanery.llm.bm25_wand import search

    docs = table(spark, sf_dir, "documents")
    return search(docs, docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text"))


SQL_BM25 = r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS t FROM documents),
l AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id), tf AS (SELECT doc_id, t, count(*) AS f FROM w GROUP BY ALL),
df AS (SELECT t, count(*) AS d FROM tf GROUP BY t), c AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM w) / (SELECT count(*) FROM documents) AS mean),
s AS (SELECT q.doc_id AS query_id, b.doc_id, round(sum(ln(1 + (c.n - d + 0.5) / (d + 0.5)) * b.f * 2.2 / (b.f + 1.2 * (0.25 + 0.75 * l.n / c.mean))), 6) AS score
  FROM tf q JOIN tf b USING (t) JOIN df USING (t) JOIN l ON l.doc_id = b.doc_id, c WHERE q.doc_id % 50 = 0 GROUP BY ALL),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
"""


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every whole text; the digests are derived from the operator's ids and texts."""
    from gleanery.llm.piece_codec import digest_table

    return digest_table(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op9_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered."""
    from gleanery.llm.chat_collapse import collapse

    return collapse(table(spark, sf_dir, "conversations"))


SQL_CHAT = """
WITH t AS (SELECT conv_id, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
  string_agg(coalesce(role, '<null>') || chr(31) || coalesce(text, '<null>'), chr(30)) OVER (w ROWS UNBOUNDED PRECEDING) AS prefix
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
f AS (SELECT n, prefix, min(conv_id) AS conv_id, count(*) AS n_copies FROM t WHERE i = n GROUP BY n, prefix),
k AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.i < t.n AND t.i = f.n AND t.prefix = f.prefix))
SELECT k.conv_id, CAST(k.n AS INTEGER) AS n_turns, k.n_copies, string_agg('<|im_start|>' || coalesce(c.role, '') || chr(10) || coalesce(c.text, '')
  || '<|im_end|>' || chr(10), '' ORDER BY c.turn NULLS FIRST, c.role NULLS FIRST, c.text NULLS FIRST) AS rendered
FROM k JOIN conversations c USING (conv_id) GROUP BY ALL
"""


def op10_jaccard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of similar documents."""
    from gleanery.llm.jaccard_tree import join

    return join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SQL_JACCARD = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [hash(w)]
  ELSE list_transform(range(1, len(w) - 3), lambda i: hash(w[i:i + 4])) END) AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * o >= 75 * (len(sa.s) + len(sb.s) - o)),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (WITH RECURSIVE t AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT g.b, t.c FROM t JOIN g ON g.a = t.d) SELECT d, min(c) AS c FROM t GROUP BY d)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.c AS component_id FROM s JOIN r ON r.d = s.doc_id
"""


def op11_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base figures and the verdict of the line-first rules; the digest is of the cleaned text."""
    from gleanery.llm.line_rules import clean

    out = clean(table(spark, sf_dir, "documents").select("doc_id", "text"))
    cols = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept lost_chars".split()
    return out.select(*cols, F.sha2("cleaned", 256).alias("cleaned_sha256"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _line_sql() -> str:
    from gleanery.llm import line_rules as R

    def count(t: str, chars: str) -> str:
        return f"length(regexp_replace({t}, {_quoted(f'[^{chars}]')}, '', 'g'))"

    marks, capitals = count("line", R.SYMBOLS + "!"), count("line", R.CAPITALS)
    phrases = " OR ".join(f"contains(lower(line), {_quoted(p)})" for p in R.PHRASES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{R.WORD}+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM p),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM g, range(3) t(o) WHERE c > 1 GROUP BY doc_id),
s AS (SELECT doc_id, string_split(t, chr(10)) AS l FROM d),
u AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS k FROM s),
v AS (SELECT *, length(regexp_replace(line, '{R.BLANK}', '', 'g')) AS size FROM u),
x AS (SELECT *, size > 0 AND ({phrases} OR {count("line", R.SEPARATORS)} >= {R.LEAST_SEPARATORS} OR regexp_matches(line, {_quoted(R.MENU)})
  OR NOT regexp_matches(line, {_quoted(R.SENTENCE)}) OR ({marks} >= {R.LEAST_MARKS} AND 100 * {marks} > {R.MOST_MARKS} * size)
  OR ({capitals} >= {R.LEAST_CAPITALS} AND 100 * {capitals} > {R.MOST_CAPITALS} * size)) AS fails FROM v),
y AS (SELECT doc_id, sum(size) AS chars, sum(CASE WHEN fails THEN size ELSE 0 END) AS lost, count(*) FILTER (WHERE size > 0) - count(DISTINCT line) FILTER (WHERE size > 0) AS dup,
  coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT fails), '') AS cleaned FROM x GROUP BY doc_id),
z AS (SELECT d.doc_id, len(w) AS n_words, CAST(chars AS BIGINT) AS word_chars, {count("t", R.SYMBOLS)} AS n_symbols, dup AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, CAST(lost AS BIGINT) AS lost_chars, cleaned
  FROM d JOIN y USING (doc_id) LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < {R.LEAST_WORDS} OR 100 * n_repeat_words > {R.MOST_REPEATED} * n_words AS base_failed FROM z)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * lost_chars <= {R.MOST_LOST} * word_chars AS kept,
  lost_chars, sha256(cleaned) AS cleaned_sha256 FROM f
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of every usable vector."""
    from gleanery.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in all 120 orders, for each source."""
    from gleanery.llm.filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL_AUDIT = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
m AS (SELECT doc_id, part, concat(CASE WHEN len(w) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' END,
  CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
  CASE WHEN doc_id > least THEN 'E' END) AS fails FROM w),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS x FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT o, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM o),
p AS (SELECT part, o, step, o[step] AS f, n, g, x, fails, list_min(list_transform(list_filter(['A', 'B', 'C', 'D', 'E'], lambda k: contains(fails, k)), lambda k: instr(o, k))) AS pos FROM c, s),
r AS (SELECT part, o, step, f, sum(CASE WHEN pos IS NULL OR pos > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN pos = step THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN pos < step AND contains(fails, f) THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN pos = step THEN g ELSE 0 END) AS good_lost, sum(CASE WHEN pos = step THEN x ELSE 0 END) AS toxic_lost FROM p GROUP BY ALL)
SELECT part, o AS filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_line_dedup, op2_url_filter, op3_token_store, op4_quality, op5_bm25_wand, op6_sentencepiece, op7_decontaminate, op8_toxicity, op9_chat_collapse, op10_jaccard_tree, op11_line_rules, op12_whitening, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": SQL_URL, "op5_bm25_wand": SQL_BM25, "op7_decontaminate": SQL_LEAKS, "op9_chat_collapse": SQL_CHAT, "op10_jaccard_tree": SQL_JACCARD, "op11_line_rules": _line_sql(), "op13_filter_audit": SQL_AUDIT}

