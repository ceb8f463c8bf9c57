"""Names and links of a knowledge base: slugs, anti-patterns, pools, provenance, link graph, discovery, clusters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.sources.shared import written

# Fixed values of the anti-pattern rules.
EXCEPTIONS = [
    "electronic-approval-system", "supply-chain-management-system", "manufacturing-execution-system", "enterprise-resource-planning", "supply-chain-management", "product-lifecycle-management", "risk-management",
    "project-integration-management", "project-scope-management", "project-schedule-management", "project-time-management", "project-cost-management", "project-quality-management", "project-resource-management", "project-human-resource-management", "project-communications-management", "project-risk-management", "project-procurement-management", "project-stakeholder-management",
]
FUNCTION_SUFFIXES = ["-management", "-service", "-support", "-processing", "-printing", "-viewer"]
BUSINESS_OBJECTS = ["quotation", "ordercontract", "purchaseorder", "deliverystatement", "taxinvoice", "inspectionreport", "salesorder", "deliverynote", "purchaseapprovalrequest", "paymentcollection"]
OPERATIONAL_ITEMS = [
    "issuelog", "meetingminutes", "incominginspection", "turnkeycontract", "deliveryspecification", "capacityanalysis", "barcode", "productintroductiondocument", "productintroduction", "weeklyreport", "businessregistrationnumber",
    "deliveryconfirmation", "3dworkspace", "workhours", "employeerole", "departmentcode", "productcategory", "paymentterm", "shipmentstatus", "returnpolicy", "warrantyperiod",
]
LABEL_SUFFIXES = ["-list", "-report", "-form"]
UI_ATOMS = ["button", "menu", "tab", "page", "screen", "dialog", "modal", "section", "panel", "widget", "icon"]
DATA_FIELDS = ["id", "code", "number", "key", "flag", "status", "count", "amount", "total"]
#: Suffixes that a cluster of names may share.
CLUSTER_SUFFIXES = ["management", "planning", "control", "analysis", "process", "system"]


def slug(text: Column) -> Column:
    s = F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}]+", "-")
    return F.regexp_replace(s, "^-+|-+$", "")


def base_name(path: Column) -> Column:
    """Last segment without .md, lower-cased."""
    return F.lower(F.regexp_replace(F.substring_index(path, "/", -1), r"(?i)\.md$", ""))


def anti_pattern(name: Column) -> Column:
    """Why a name is no concept: the code of the first rule that fits, else null."""
    low = F.lower(name)
    bare = F.replace(low, F.lit("-"), F.lit(""))
    short = F.size(F.split(low, "-")) <= 3
    r = F.when(name.rlike("[\\uAC00-\\uD7A3]"), "hangul-label").when(low.isin(EXCEPTIONS), None)
    for s in FUNCTION_SUFFIXES:
        r = r.when(low.endswith(s), "function" + s)
    r = r.when(bare.isin(BUSINESS_OBJECTS), "business-object").when(bare.isin(OPERATIONAL_ITEMS), "operational-item")
    for s in LABEL_SUFFIXES:
        r = r.when(low.endswith(s), "label" + s)
    return r.when(low.rlike(f"-({'|'.join(UI_ATOMS)})$"), "ui-element").when(low.rlike(f"-({'|'.join(DATA_FIELDS)})$") & short, "data-field")


def canonical(names: DataFrame, aliases: DataFrame, col: str = "slug") -> DataFrame:
    """names with `col` replaced by its alias's target where there is one. aliases: alias, target; Spark broadcasts them
    if they are small."""
    a = aliases.select(F.col("alias").alias("_a"), F.col("target").alias("_t"))
    return names.join(a, F.col(col) == F.col("_a"), "left").withColumn(col, F.coalesce("_t", col)).drop("_a", "_t")


def valid_types(mentions: DataFrame, entity: list[str], concept: list[str]) -> DataFrame:
    """Adds pool (entity, concept or null) and reason."""
    h = F.col("type_hint")
    none = h.isNull() | h.isin("", "unknown")
    pool = F.when(none, None).when(h.isin(entity), "entity").when(h.isin(concept), "concept")
    return mentions.withColumns({"pool": pool, "reason": F.when(none, "no hint").when(~h.isin(entity + concept), "not in schema")})


def forced(pages: DataFrame, pins: DataFrame) -> DataFrame:
    """pages (slug, pool, type) with pinned pool and type; one row for each pool and slug, the first by type."""
    p = pins.select("slug", F.col("pool").alias("_p"), F.col("type").alias("_t"))
    j = pages.join(p, "slug", "left").select("slug", F.coalesce("_p", "pool").alias("pool"), F.coalesce("_t", "type").alias("type"))
    return j.groupBy("pool", "slug").agg(F.min("type").alias("type"))


def cross_pool(pages: DataFrame) -> DataFrame:
    """Concepts that are entities too go; the entity stays."""
    e = pages.where("pool = 'entity'")
    c = pages.where("pool = 'concept'").join(e.select("slug"), "slug", "left_anti")
    return e.unionByName(c.select(e.columns))


def initials(name: Column) -> Column:
    return F.array_join(F.transform(F.split(name, "-"), lambda w: F.substring(w, 1, 1)), "")


def acronyms(pages: DataFrame) -> DataFrame:
    """slug, full: short names (at most 6 characters, no separator) that are the initials of a longer name; of several
    the least."""
    full = pages.where(F.contains("slug", F.lit("-"))).select(F.col("slug").alias("full"), initials(F.col("slug")).alias("_i"))
    short = pages.where("length(slug) <= 6 AND instr(slug, '-') = 0").select("slug").distinct()
    return short.join(full, F.col("slug") == F.col("_i")).groupBy("slug").agg(F.min("full").alias("full"))


def cross_links(pages: DataFrame) -> DataFrame:
    """cycle, slug, links: every entity of a cycle with every concept of it and back, sorted, without itself."""
    e = pages.where("pool = 'entity'").groupBy("cycle").agg(F.array_sort(F.collect_set("slug")).alias("_e"))
    c = pages.where("pool = 'concept'").groupBy("cycle").agg(F.array_sort(F.collect_set("slug")).alias("_c"))
    j = pages.join(e, "cycle", "left").join(c, "cycle", "left")
    other = F.when(F.col("pool") == "entity", F.col("_c")).otherwise(F.col("_e"))
    return j.select("cycle", "slug", F.filter(F.coalesce(other, F.array().cast("array<string>")), lambda x: x != F.col("slug")).alias("links"))


# links

def edges(pages: DataFrame, text: str, pattern: str = r"\[\[([^\]|#]+)") -> DataFrame:
    """src, dst, pos: link targets by base name, in order; pattern's first group is the target."""
    got = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    e = pages.select("src", F.posexplode(got).alias("pos", "target"))
    return e.select("src", base_name(F.trim("target")).alias("dst"), "pos").where("dst <> ''")


def backlinks(links: DataFrame) -> DataFrame:
    """dst, n_sources: distinct pages that link to a page, itself not counted."""
    return links.where("src <> dst").groupBy("dst").agg(F.count_distinct("src").alias("n_sources"))


def broken(links: DataFrame, pages: DataFrame) -> DataFrame:
    """src, dst of links without a page."""
    return links.select("src", "dst").distinct().join(pages.select(F.col("src").alias("dst")), "dst", "left_anti").select("src", "dst")


def unlinked(links: DataFrame, pages: DataFrame) -> DataFrame:
    return pages.select("src").join(links.select(F.col("dst").alias("src")), "src", "left_anti")


def one_hop(links: DataFrame, base: DataFrame, k: int = 5) -> DataFrame:
    """dst, n, first: targets of the base pages by number of links, then first place; base pages themselves left out."""
    l = links.join(base, "src", "left_semi").join(base.select(F.col("src").alias("dst")), "dst", "left_anti")
    return l.groupBy("dst").agg(F.count("*").alias("n"), F.min(F.struct("pos", "src")).alias("first")).orderBy(F.desc("n"), "first", "dst").limit(k).select("dst", "n", F.col("first.pos").alias("first"))


def provenance(refs: DataFrame) -> DataFrame:
    """page, kind, ref, pos: one row for each kind and ref of a page, the first."""
    return refs.groupBy("page", "kind", "ref").agg(F.min("pos").alias("pos"))


# discovery

def common_prefix(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    i = F.array_position(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.substring(a, k, F.lit(1)) == F.substring(b, k, F.lit(1))), False)
    return F.when(n == 0, "").when(i == 0, F.substring(a, F.lit(1), n)).otherwise(F.substring(a, F.lit(1), (i - 1).cast("int")))


def co_occurrence(mentions: DataFrame, least: int = 3, length: int = 5) -> DataFrame:
    """source, head, prefix, n: names of a source with one first word, at least `least`, with the longest prefix they
    share, cut at its last separator; the prefix of a set is that of its least and greatest member."""
    m = mentions.select("source", "slug").distinct().withColumn("head", F.substring_index("slug", "-", 1))
    g = m.groupBy("source", "head").agg(F.count("*").alias("n"), F.min("slug").alias("lo"), F.max("slug").alias("hi")).where(F.col("n") >= least)
    p = g.withColumn("prefix", F.regexp_replace(common_prefix(F.col("lo"), F.col("hi")), "[-_][^-_]*$", ""))
    return p.where(F.length("prefix") >= length).select("source", "head", "prefix", "n")


def suffix_clusters(mentions: DataFrame, suffixes: list[str], least: int = 2) -> DataFrame:
    """suffix, n_sources, n_mentions, n_slugs of suffixes that names of at least `least` sources end with."""
    s = F.explode(F.array(*[F.lit(x) for x in suffixes]))
    m = mentions.select("source", "slug", s.alias("suffix")).where(F.col("slug").endswith(F.concat(F.lit("-"), F.col("suffix"))))
    return m.groupBy("suffix").agg(F.count_distinct("source").alias("n_sources"), F.count("*").alias("n_mentions"), F.count_distinct("slug").alias("n_slugs")).where(F.col("n_sources") >= least)


def confidence(support: Column, suffixes: Column, mentions: Column, overlap: Column) -> Column:
    return 0.4 * F.least(support / 5, F.lit(1.0)) + 0.3 * F.when(suffixes <= 1, 1.0).otherwise(0.5) + 0.2 * F.least(mentions / 20, F.lit(1.0)) + 0.1 * F.when(overlap, 0.0).otherwise(1.0)


def signature(umbrella: Column, slugs: Column) -> Column:
    return F.sha1(F.concat(umbrella, F.lit("::"), F.array_join(F.array_sort(slugs), "|")))


def suggestions(candidates: DataFrame, rejected: DataFrame, cutoff: float = 0.6) -> DataFrame:
    """Candidates the signature of which was not rejected, of enough confidence."""
    return candidates.join(rejected.select("signature"), "signature", "left_anti").where(F.col("confidence") >= cutoff)


def mean_vectors(vectors: DataFrame, key: str) -> DataFrame:
    """key, mean: element-wise mean, by aggregating positions."""
    p = vectors.select(key, F.posexplode("embedding").alias("i", "v")).groupBy(key, "i").agg(F.avg("v").alias("m"))
    return p.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x.m).alias("mean"))


def similarity_edges(vectors: DataFrame, least: float, planes: int = 0) -> DataFrame:
    """a, b, cosine of all pairs at least that similar (a < b). Vectors are few (one for a name); they are compared in
    blocks: every vector goes to each pair of blocks that its own is in, and numpy multiplies the blocks."""
    import numpy as np
    import pandas as pd

    n = max(1, -(-vectors.count() // 2000))
    v = vectors.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("me"))
    v = v.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("vec_id", "embedding", "me", F.least("me", "other").alias("x"), F.greatest("me", "other").alias("y"))

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = int(pdf.x.iloc[0]), int(pdf.y.iloc[0])
        m = np.array(pdf.embedding.tolist(), float)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
        ids, me = pdf.vec_id.to_numpy(), pdf.me.to_numpy()
        c = m @ m.T
        i, j = np.nonzero((c >= least - 1e-9) & (ids[:, None] < ids[None, :]) & ((me[:, None] != me[None, :]) | (x == y)))
        return pd.DataFrame({"a": ids[i], "b": ids[j], "cosine": c[i, j]})

    return v.groupBy("x", "y").applyInPandas(pairs, "a long, b long, cosine double")


def min_labels(pairs: DataFrame, most: int = 100) -> DataFrame:
    """node, cluster (its least member) of the nodes of pairs (a, b). Labels go along edges and are then looked up
    themselves; each round is checkpointed, which cuts lineage, and the last changes nothing."""
    both = written(pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e")).select("e.node", "e.other").distinct(), "edges")
    now = both.groupBy("node").agg(F.least(F.first("node"), F.min("other")).alias("cluster"))
    for _ in range(most):
        near = both.join(now.select(F.col("node").alias("other"), "cluster"), "other").groupBy("node").agg(F.min("cluster").alias("c"))
        step = now.join(near, "node").select("node", F.least("cluster", "c").alias("cluster"))
        jump = step.join(step.select(F.col("node").alias("cluster"), F.col("cluster").alias("c")), "cluster", "left").select("node", F.least("cluster", F.coalesce("c", "cluster")).alias("cluster"))
        new = jump.checkpoint()
        moved = new.join(now.select("node", F.col("cluster").alias("c")), "node").where("cluster <> c").limit(1).count()
        now = new
        if not moved:
            return now
    raise RuntimeError("clusters did not settle")


def cluster_stats(clusters: DataFrame, mentions: DataFrame) -> DataFrame:
    """cluster, n_members, n_sources, n_mentions (each member's distinct sources, summed)."""
    m = clusters.join(mentions.distinct(), "node")
    per = m.groupBy("cluster").agg(F.count_distinct("source").alias("n_sources"), F.count("*").alias("n_mentions"))
    n = clusters.groupBy("cluster").agg(F.count("*").alias("n_members"))
    return n.join(per, "cluster")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def first_of(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")
