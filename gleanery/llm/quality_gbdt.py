"""Quality classifier: histogram gradient-boosted trees over statistics of a document's text.

Trees are grown level by level on binned statistics and kept as flat arrays of a complete binary tree each, so a
batch of documents descends all trees at once with a few numpy gathers per level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gleanery.llm.common import pieces, texts, tidy, tune
from gleanery.llm.segments import DIGIT, NEWLINE, OTHER, PUNCT, SPACE, classes, segment_hashes

#: Names of the statistics. None of them is a label, a language, a source or an id.
FEATURES = "log_bytes upper digit mark prose_mark other non_ascii space line_len word_len distinct_words repeated_next top_gap bar bang distinct_lines".split()


def statistics(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; an empty or null text has zeros."""
    out = []
    for i, j, buf, offs in pieces(*texts(column)):
        n_docs, size = j - i, np.diff(offs).astype(float)
        f = np.zeros((n_docs, len(FEATURES)))
        full = size > 0
        if len(buf):
            cls, at = classes(buf), offs[:-1][full]
            count = lambda m: np.add.reduceat(m.view(np.uint8), at, dtype=np.int64).astype(float)  # noqa: E731, B023
            prose = (buf == 44) | (buf == 46)
            bar, bang = buf == 124, buf == 33
            line, space = cls == NEWLINE, cls == SPACE
            chars = size[full]
            f[full, 0] = np.log1p(chars)
            for k, m in ((1, (buf >= 65) & (buf <= 90)), (2, cls == DIGIT), (3, (cls == PUNCT) & ~prose & ~bar & ~bang), (4, prose), (5, (cls == OTHER) & (buf < 128)), (6, buf >= 128), (7, space), (13, bar), (14, bang)):
                f[full, k] = count(m) / chars
            gap = space | line | (buf == 9)
            first = ~gap
            first[1:] &= gap[:-1]
            first[offs[:-1][full]] = ~gap[offs[:-1][full]]
            starts = np.flatnonzero(first)
            stop = np.append(np.flatnonzero(gap), len(buf))
            ends = np.minimum(stop[np.searchsorted(stop, starts)], offs[np.searchsorted(offs, starts, "right")])
            doc = np.searchsorted(offs, starts, "right") - 1
            f[:, 8:13], f[:, 15] = 0, 0
            lines = np.zeros(n_docs)
            lines[full] = count(line) + 1
            f[full, 8] = np.log1p(size[full] / lines[full])
            if len(starts):
                words = np.bincount(doc, minlength=n_docs).astype(float)
                has = words > 0
                h = segment_hashes(buf, starts, ends)
                own = h ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                _, one, times = np.unique(own, return_index=True, return_counts=True)
                f[has, 9] = np.bincount(doc, (ends - starts), n_docs)[has] / words[has]
                f[has, 10] = np.bincount(doc[one], minlength=n_docs)[has] / words[has]
                same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
                f[has, 11] = np.bincount(doc[1:][same], minlength=n_docs)[has] / words[has]
                most = np.zeros(n_docs)
                np.maximum.at(most, doc[one], times)
                f[has, 12] = most[has] / words[has]
            cut = np.append(0, np.flatnonzero(line) + 1)
            cut = np.unique(np.concatenate([cut[cut < len(buf)], offs[:-1][full]]))
            stop = np.append(cut[1:], len(buf))
            stop = np.where(buf[stop - 1] == 10, stop - 1, stop)
            ldoc = np.searchsorted(offs, cut, "right") - 1
            lh = segment_hashes(buf, cut, np.maximum(stop, cut)) ^ (ldoc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            _, one = np.unique(lh, return_index=True)
            f[full, 15] = (np.bincount(ldoc[one], minlength=n_docs) / np.maximum(1, np.bincount(ldoc, minlength=n_docs)))[full]
        out.append(f)
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


@dataclass(frozen=True)
class Boosted:
    """Flat trees: of depth d, inner nodes 0 .. 2**d - 2, node k has children 2k + 1 and 2k + 2."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # a value above goes right
    leaf: np.ndarray  # trees x 2**d

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        if not len(x):
            return np.zeros(0)
        trees, depth = len(self.leaf), int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))[:, None]
        if trees:
            at, t = np.zeros((len(x), trees), np.int64), np.arange(trees)[None, :]
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, self.feature[t, at]] > self.cut[t, at])
            total = total + self.leaf[t, at - (2**depth - 1)].sum(1)
        return 1 / (1 + np.exp(-total))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 1.0) -> Boosted:
    """Logistic gradient boosting on quantile histograms. Without rows, every score is 0.5; with one class, its rate."""
    n, m = x.shape
    if not n:
        return Boosted(0.0, np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 2)))
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = float(np.log(p / (1 - p)))
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(m)]
    code = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1)  # code > b if x > edges[b]
    raw, inner = np.full(n, base), 2**depth - 1
    feat, cuts, leaves = [], [], []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-raw))
        g, h, at = y - q, q * (1 - q), np.zeros(n, np.int64)
        f_t, c_t = np.zeros(inner, int), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-9)
            for k in range(m):
                if not len(edges[k]):
                    continue
                slot = (at - first) * (bins + 1) + code[:, k]
                gs = np.bincount(slot, g, width * (bins + 1)).reshape(width, -1).cumsum(1)
                hs = np.bincount(slot, h, width * (bins + 1)).reshape(width, -1).cumsum(1)
                gl, hl, ga, ha = gs[:, : len(edges[k])], hs[:, : len(edges[k])], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + l2) + (ga - gl) ** 2 / (ha - hl + l2) - ga**2 / (ha + l2)
                gain[(hl < least) | (ha - hl < least)] = 0
                b = gain.argmax(1)
                won = gain[np.arange(width), b] > best
                best = np.where(won, gain[np.arange(width), b], best)
                f_t[first : first + width][won], c_t[first : first + width][won] = k, edges[k][b[won]]
            at = 2 * at + 1 + (x[np.arange(n), f_t[at]] > c_t[at])
        at -= inner
        leaf = rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + l2)
        raw += leaf[at]
        feat.append(f_t)
        cuts.append(c_t)
        leaves.append(leaf)
    return Boosted(base, np.array(feat), np.array(cuts), np.array(leaves))


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo mod."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(mod))


def sample_of_labels(labels: DataFrame, label: str, where: Column, rows: int) -> DataFrame:
    """At most `rows` labelled ids, in the order of a hash of the id: doc_id, y. Rows with a null id or label are left
    out; an id with several labels has their mean."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & where)
    known = known.groupBy("doc_id").agg(F.avg(F.col(label).cast("double")).alias("y"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def fit(docs: DataFrame, labels: DataFrame, where: Column, rows: int = 20_000) -> Boosted:
    """Trees learned from at most `rows` labelled documents (the bound of the sample) for which `where` holds. Only
    their statistics, a few floats each, come to the driver."""
    tune(docs.sparkSession)

    def run(batches):
        for b in batches:
            f = statistics(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(f), pa.list_(pa.float64()))], ["y", "f"])

    picked = sample_of_labels(labels, "quality", where, rows)
    # at most `rows` rows of two numbers, so it may be broadcast
    got = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("y", "text").mapInArrow(tidy(run), "y double, f array<double>").collect()
    x = np.array([r.f for r in got]).reshape(-1, len(FEATURES))
    y = np.array([r.y for r in got])
    order = np.lexsort((*x.T, y))  # the same trees whatever order the rows come in
    return boost(x[order], y[order])


def score(docs: DataFrame, model: Boosted) -> DataFrame:
    """docs with a column score (a column of that name is replaced); no shuffle. Null text counts as empty, which has
    a score too; repeated rows are scored each; an empty table gives none."""
    tune(docs.sparkSession)
    docs = docs.drop("score")
    names = docs.columns

    def run(batches):
        for b in batches:
            s = model.score(statistics(b.column(names.index("text"))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*names, "score"])

    return docs.mapInArrow(tidy(run), StructType([*docs.schema.fields, StructField("score", DoubleType())]))
