"""Toxicity: words are bags of hashed character n-grams, embeddings of which are averaged into a linear softmax.

A document is cut into overlapping windows of words. A window's vector is the mean of its words' vectors, a word's
vector the mean of its n-grams' embeddings, and the document's class scores are those of its most toxic window, so a
short insult counts as much in a long text. Embeddings and the softmax are trained jointly in numpy; a misspelt word
that was never seen shares most of its n-gram vectors with the word it comes from.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gleanery.llm.common import kept, pieces, texts, tidy, tune
from gleanery.llm.quality_gbdt import sample_of_labels
from gleanery.llm.segments import LETTER, OTHER, classes, mix, ragged, segment_hashes

SIZES = (3, 4, 5)


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z and the capitals among U+00C0 to U+00DE in lower case; same length."""
    out = buf + np.where((buf >= 65) & (buf <= 90), 32, 0).astype(np.uint8)
    lead = np.flatnonzero(buf[:-1] == 0xC3)
    low = lead[(buf[lead + 1] >= 0x80) & (buf[lead + 1] <= 0x9E) & (buf[lead + 1] != 0x97)] + 1
    out[low] += 32
    return out


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, text number of the runs of letters, digits and non-ASCII characters of lower-cased bytes."""
    cls = classes(buf)
    inside = np.zeros(len(buf) + 1, bool)
    inside[:-1] = (cls == LETTER) | (cls == 5) | ((cls == OTHER) & (buf >= 128))
    head = inside[:-1].copy()
    head[1:] &= ~inside[:-2]
    own = offs[:-1][offs[:-1] < len(buf)]
    head[own] = inside[own]
    starts = np.flatnonzero(head)
    stop = np.flatnonzero(~inside)
    ends = stop[np.searchsorted(stop, starts)] if len(starts) else starts
    doc = np.searchsorted(offs, starts, "right") - 1
    return starts, np.minimum(ends, offs[doc + 1]), doc


def grams(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of each word's character n-grams (with a mark at both ends) and of the word itself, and how many
    each word has. Byte n-grams stand for character n-grams."""
    n = len(starts)
    lens = ends - starts + 2
    flat = np.full(int(lens.sum()), 1, np.uint8)
    first = np.cumsum(lens) - lens
    flat[ragged(first + 1, lens - 2)] = buf[ragged(starts, lens - 2)]
    at, word = [first], [np.arange(n)]
    hs = [segment_hashes(flat, first, first + lens, 3)]
    for k in SIZES:
        c = np.maximum(0, lens - k + 1)
        s = ragged(first, c)
        at.append(s)
        word.append(np.repeat(np.arange(n), c))
        hs.append(segment_hashes(flat, s, s + k, 3 + k))
    word, h = np.concatenate(word), np.concatenate(hs)
    order = np.argsort(word, kind="stable")
    return (mix(h[order]) % np.uint64(buckets)).astype(np.int32), np.bincount(word, minlength=n)


def window_starts(counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end and document of windows of `width` words, half overlapping; a shorter document is one."""
    step = max(1, width // 2)
    n = np.where(counts > 0, np.maximum(1, -(-(counts - width) // step) + 1), 0)
    doc = np.repeat(np.arange(len(counts)), n)
    base = np.cumsum(counts) - counts
    s = base[doc] + (np.arange(len(doc)) - (np.cumsum(n) - n)[doc]) * step
    return s, np.minimum(s + width, (base + counts)[doc]), doc


@dataclass(frozen=True)
class Subwords:
    """logit of an n-gram: its embedding times the difference of the softmax's two rows."""

    gram: np.ndarray
    bias: float
    width: int

    def word_logits(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        g, c = grams(buf, starts, ends, len(self.gram))
        return np.add.reduceat(self.gram[g], np.cumsum(c) - c) / c if len(c) else np.zeros(0)

    def score(self, column: pa.Array, known: WordScores) -> np.ndarray:
        out = []
        for i, j, buf, offs in pieces(*texts(column)):
            logit = np.full(j - i, self.bias)
            if len(buf):
                buf = lower(buf)
                starts, ends, doc = words(buf, offs)
                z = np.append(0, np.cumsum(known.get(self, buf, starts, ends)))
                s, e, d = window_starts(np.bincount(doc, minlength=j - i), self.width)
                if len(s):
                    best = np.full(j - i, -np.inf)
                    np.maximum.at(best, d, (z[e] - z[s]) / self.width)
                    logit = np.where(np.isfinite(best), best + self.bias, logit)
            out.append(1 / (1 + np.exp(-logit)))
        return np.concatenate(out) if out else np.zeros(0)


class WordScores:
    """Logits by word hash, at most `most` of them; beyond that it starts anew."""

    def __init__(self, most: int = 1_000_000):
        self.most, self.keys, self.vals = most, np.zeros(0, np.uint64), np.zeros(0)

    def get(self, model: Subwords, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0)
        u, first, back = np.unique(segment_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(u) > self.most:
            self.keys, self.vals = np.zeros(0, np.uint64), np.zeros(0)
        p = np.searchsorted(self.keys, u)
        hit = self.keys[np.minimum(p, len(self.keys) - 1)] == u if len(self.keys) else np.zeros(len(u), bool)
        out = np.empty(len(u))
        out[hit] = self.vals[p[hit]]
        new = ~hit
        if new.any():
            out[new] = model.word_logits(buf, starts[first[new]], ends[first[new]])
            self.keys, self.vals = np.insert(self.keys, p[new], u[new]), np.insert(self.vals, p[new], out[new])
        return out[back]


def train(column: pa.Array, y: np.ndarray, width: int = 8, dim: int = 8, buckets: int = 1 << 18, epochs: int = 8, batch: int = 256, rate: float = 0.5, seed: int = 1) -> Subwords:
    """Joint AdaGrad steps on embeddings and softmax. The first epoch sees the mean of a document's windows, later
    ones its most toxic window. Without both classes, the score is the constant rate (0.5 without rows)."""
    y = np.asarray(y, float)
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    prior = float(np.log(p / (1 - p)))
    if not len(y) or y.min() == y.max():
        return Subwords(np.zeros(buckets, np.float32), prior, width)
    hashes, counts, known, g, c = [], [], np.zeros(0, np.uint64), [], []
    for i, j, buf, offs in pieces(*texts(column)):  # a piece at a time, so that memory is small
        buf = lower(buf)
        starts, ends, doc = words(buf, offs)
        h = segment_hashes(buf, starts, ends)
        hashes.append(h)
        counts.append(np.bincount(doc, minlength=j - i))
        u, first = np.unique(h, return_index=True)
        new = ~np.isin(u, known, assume_unique=True)
        known = np.append(known, u[new])  # in the order in which words are first met
        part = grams(buf, starts[first[new]], ends[first[new]], buckets)
        g.append(part[0])
        c.append(part[1])
    hashes, counts, g, c = (np.concatenate(x) for x in (hashes, counts, g, c))
    order = np.argsort(known)
    back = order[np.searchsorted(known[order], hashes)].astype(np.int32)
    del hashes
    gat = np.append(0, np.cumsum(c))
    s, e, d = window_starts(counts, width)
    wat = np.searchsorted(d, np.arange(len(y) + 1))
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (buckets, dim)).astype(np.float32)
    soft = np.concatenate([np.full((1, dim), -0.5), np.full((1, dim), 0.5)]).astype(np.float32)
    bias = np.array([0.0, prior])
    emb2, soft2, bias2 = np.full(buckets, 1e-6, np.float32), np.full_like(soft, 1e-6), np.full(2, 1e-6)
    weight = np.where(y > 0.5, 0.5 / p, 0.5 / (1 - p))
    docs = np.flatnonzero(counts > 0)
    for epoch in range(epochs):
        rng.shuffle(docs)
        for k in range(0, len(docs), batch):
            part = docs[k : k + batch]
            nw = wat[part + 1] - wat[part]
            win = ragged(wat[part], nw)
            wdoc = np.repeat(np.arange(len(part)), nw)
            ln = e[win] - s[win]
            tok = back[ragged(s[win], ln)]
            wtok = np.repeat(np.arange(len(win)), ln)
            uniq, ub = np.unique(tok, return_inverse=True)
            gi = ragged(gat[uniq], c[uniq])
            gb, gl = g[gi], np.cumsum(c[uniq]) - c[uniq]
            vec = np.add.reduceat(emb[gb], gl, axis=0) / c[uniq][:, None]
            diff = soft[1] - soft[0]
            zw = vec @ diff
            z = np.bincount(wtok, zw[ub], len(win)) / width
            if epoch:
                top = np.lexsort((z, wdoc))[np.cumsum(nw) - 1]
                share = np.zeros(len(win))
                share[top] = 1
            else:
                share = 1 / np.repeat(nw, nw)
            logit = np.bincount(wdoc, z * share, len(part)) + bias[1] - bias[0]
            err = (1 / (1 + np.exp(-logit)) - y[part]) * weight[part]
            dz = err[wdoc] * share / width
            dword = np.bincount(ub, dz[wtok], len(uniq))
            live = np.flatnonzero(dword)
            dsoft = (dword[live] @ vec[live]) / len(part) ** 0.5
            # gradients of the embeddings: each n-gram of a word gets the word's share
            li = ragged(gl[live], c[uniq][live])
            lb = gb[li]
            amount = np.repeat(dword[live] / c[uniq][live], c[uniq][live])
            rows, rb = np.unique(lb, return_inverse=True)
            per = np.bincount(rb, amount, len(rows)).astype(np.float32)
            step = per[:, None] * diff[None, :]
            emb2[rows] += (step**2).mean(1)
            emb[rows] -= rate * step / np.sqrt(emb2[rows])[:, None]
            for r, sign in ((0, -1), (1, 1)):
                grad = sign * dsoft
                soft2[r] += grad**2
                soft[r] -= (0.1 * rate * grad / np.sqrt(soft2[r])).astype(np.float32)
            gbias = np.array([-err.sum(), err.sum()]) / len(part)
            bias2 += gbias**2
            bias -= 0.5 * rate * gbias / np.sqrt(bias2)
    return Subwords((emb @ (soft[1] - soft[0])).astype(np.float32), float(bias[1] - bias[0]), width)


def fit(docs: DataFrame, labels: DataFrame, where, rows: int = 8_000) -> Subwords:
    """Learned on the driver from the whole texts of at most `rows` labelled documents, long ones too (the bound of the
    sample)."""
    tune(docs.sparkSession)
    picked = sample_of_labels(labels, "toxic", where, rows)
    # at most `rows` rows of two numbers, so it may be broadcast
    got = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("y", "text", F.xxhash64("doc_id", "text").alias("h")).toArrow().combine_chunks()
    got = got.sort_by([("h", "ascending"), ("y", "ascending")])
    return train(got["text"].combine_chunks() if got.num_rows else pa.array([], pa.string()), got["y"].to_numpy())


def score(docs: DataFrame, model: Subwords) -> DataFrame:
    """docs with a column score (a column of that name is replaced); no shuffle. Null text counts as empty, whose score
    is that of no evidence; repeated rows are scored each; an empty table gives none; long texts are scored whole."""
    tune(docs.sparkSession)
    docs = docs.drop("score")
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of floats
    name = hashlib.sha256(model.gram.tobytes() + str((model.bias, model.width)).encode()).hexdigest()

    def run(batches):
        cache = kept("word-scores", dict)  # of one model at a time
        if name not in cache:
            cache.clear()
        known = cache.setdefault(name, WordScores())
        for b in batches:
            s = shared.value.score(b.column(names.index("text")), known)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*names, "score"])

    return docs.mapInArrow(tidy(run), StructType([*docs.schema.fields, StructField("score", DoubleType())]))
