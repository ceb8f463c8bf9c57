"""N-gram Jaccard join: documents whose sets of 5-word shingles have a Jaccard similarity of at least 3/4.

1. Equal sets are one set from then on (its id: a 64-bit hash of the set).
2. Filter. A set's smaller half in hash order (its prefix) must share at least a fixed number of shingles with a
   partner's prefix. Sets without so many prefix shingles that any other prefix has too have no partner. Of the sets
   that are left, those also go of which less than three quarters of all shingles are in others that are left.
3. The sets that are left meet in buckets of equal shingles. In a bucket, a signature tree is built: nodes hold the
   OR of their sets' bitmaps and the range of their sizes. A dual traversal drops pairs of nodes that are of one
   component already, or whose largest possible overlap is too small; pairs of leaves are verified.
4. Buckets of the two smallest shared shingles are verified with the sets at hand, which joins most groups. Shingles
   that still lie in several components then give candidate pairs across these, which are verified by a join.
Every link between different sets either is verified or lies within a component that is connected without it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.llm.common import checked, pieces, texts, tidy, tune, written
from gleanery.llm.components import components
from gleanery.llm.segments import mix, ragged, segment_hashes

WORDS = 5
#: Sets of a bucket that one task takes at a time, and members of a group that stand for it when parts of a bucket meet.
BLOCK, DELEGATES = 4096, 16
#: Pairs of two components that are verified before all others.
PROBES = 4
BITS, FAN = 4096, 16


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text: A-Z lowered, words are runs of other characters than space
    and U+0009 to U+000D; fewer than five words make one shingle, none make no shingle."""
    out: list[np.ndarray] = []
    for i, j, buf, offs in pieces(*texts(column)):
        if not len(buf):
            out += [np.zeros(0, np.uint64)] * (j - i)
            continue
        buf = buf + np.where((buf >= 65) & (buf <= 90), 32, 0).astype(np.uint8)
        gap = (buf == 32) | ((buf >= 9) & (buf <= 13))
        head = ~gap
        head[1:] &= gap[:-1]
        own = offs[:-1][offs[:-1] < len(buf)]
        head[own] = ~gap[own]
        starts = np.flatnonzero(head)
        doc = np.searchsorted(offs, starts, "right") - 1
        stop = np.append(np.flatnonzero(gap), len(buf))
        ends = np.minimum(stop[np.searchsorted(stop, starts)], offs[doc + 1])
        wh = segment_hashes(buf, starts, ends, 10)
        n = np.bincount(doc, minlength=j - i)
        many = np.maximum(n - WORDS + 1, np.minimum(n, 1))
        at = ragged(np.cumsum(n) - n, many)
        size = np.repeat(np.minimum(n, WORDS), many)
        h = size.astype(np.uint64)
        for k in range(WORDS):
            h = np.where(size > k, mix(h + wh[np.minimum(at + k, len(wh) - 1)] * np.uint64(2 * k + 3)), h) if len(wh) else h
        ends = np.cumsum(many)
        out += [np.unique(h[e - m : e]) for e, m in zip(ends.tolist(), many.tolist(), strict=True)]
    return out


def set_id(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.sha256(s.tobytes()).digest()[:8], "little", signed=True)


def three_quarters(n):
    return -(-3 * n // 4)


def prefix(n):
    """How many of the smallest hashes the filter looks at: n - ceil(3n/4) + ceil(n/4). Two similar sets share at least
    the smaller ceil(n/4) of the two among them."""
    return n - three_quarters(n) + -(-n // 4)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) * 100 < 75 * max(len(a), len(b)):
        return False
    p = np.searchsorted(b, a)
    both = int((b[np.minimum(p, len(b) - 1)] == a).sum())
    return 100 * both >= 75 * (len(a) + len(b) - both)


def bitmap(s: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITS, np.uint8)
    bits[(s >> np.uint64(13)).astype(np.int64) & (BITS - 1)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


class Groups:
    """Labels of the members of one bucket; the smaller group takes the larger one's label."""

    def __init__(self, labels):
        _, self.label = np.unique(np.asarray(labels), return_inverse=True)
        self.members = {int(k): np.flatnonzero(self.label == k).tolist() for k in range(int(self.label.max()) + 1)} if len(self.label) else {}

    def join(self, x: int, y: int) -> None:
        a, b = int(self.label[x]), int(self.label[y])
        if len(self.members[a]) > len(self.members[b]):
            a, b = b, a
        self.label[self.members[a]] = b
        self.members[b] += self.members.pop(a)


class SignatureTree:
    """Level 0 has one node for each set, in the order given (by size); each level above has one for FAN below."""

    def __init__(self, n: np.ndarray, bits: np.ndarray):
        surplus = n - np.bitwise_count(bits).sum(1).astype(np.int64)  # shingles that fell on a bit already set
        self.levels = [(bits, n, n, surplus)]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, extra = self.levels[-1]
            at = np.arange(0, len(bits), FAN)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(extra, at)))

    def may_link(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For the nodes a x b of a level: whether a pair of sets below may be similar, by sizes and the largest overlap
        (common bits of the ORs, and shingles beyond one a bit)."""
        bits, low, high, extra = self.levels[level]
        sizes = (4 * high[a][:, None] >= 3 * low[b][None, :]) & (4 * high[b][None, :] >= 3 * low[a][:, None])
        most = np.bitwise_count(bits[a][:, None, :] & bits[b][None, :, :]).sum(2).astype(np.int64) + np.minimum(extra[a][:, None], extra[b][None, :])
        most = np.minimum(most, np.minimum(high[a][:, None], high[b][None, :]))
        return sizes & (7 * most >= 3 * (low[a][:, None] + low[b][None, :]))

    def pairs(self, groups: Groups):
        """Pairs of leaves in different groups that are not pruned. Groups may be joined meanwhile."""
        n, top = len(self.levels[0][0]), len(self.levels) - 1
        if n < 2:
            return
        todo = [(top, 0, 0)]
        while todo:
            level, i, j = todo.pop()
            span = FAN**level
            li, lj = groups.label[i * span : (i + 1) * span], groups.label[j * span : (j + 1) * span]
            if (li == li[0]).all() and (lj == li[0]).all():
                continue
            width = len(self.levels[level - 1][0])
            a, b = np.arange(i * FAN, min((i + 1) * FAN, width)), np.arange(j * FAN, min((j + 1) * FAN, width))
            ok = self.may_link(level - 1, a, b)
            if level > 1:
                todo += [(level - 1, int(a[x]), int(b[y])) for x, y in np.argwhere(ok) if a[x] <= b[y]]
                continue
            for x, y in np.argwhere(ok & (a[:, None] < b[None, :])):
                if groups.label[a[x]] != groups.label[b[y]]:
                    yield int(a[x]), int(b[y])


def bucket_links(ids: list[int], sets: list[np.ndarray], labels=None) -> list[tuple[int, int]]:
    """Verified edges that connect what all links in a bucket connect."""
    order = sorted(range(len(ids)), key=lambda k: (len(sets[k]), ids[k]))
    ids, sets = [ids[k] for k in order], [sets[k] for k in order]
    groups = Groups(range(len(ids)) if labels is None else [labels[k] for k in order])
    out = []

    def check(x: int, y: int) -> None:
        if groups.label[x] != groups.label[y] and similar(sets[x], sets[y]):
            groups.join(x, y)
            out.append((ids[x], ids[y]))

    mid = len(ids) // 2
    for k in range(len(ids)):  # a bucket is mostly one group: neighbours in size and the middle one first
        check(mid, k)
        if k:
            check(k - 1, k)
    if len(set(groups.label.tolist())) > 1:
        tree = SignatureTree(np.array([len(s) for s in sets], np.int64), np.stack([bitmap(s) for s in sets]))
        for x, y in tree.pairs(groups):
            check(x, y)
    return out


def _runs(batches, n_keys: int = 1):
    """Whole buckets of a stream sorted by its first n_keys columns, one table each."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        rest = t if rest is None else pa.concat_tables([rest, t])
        if not rest.num_rows:
            continue
        keys = [rest.column(k).to_numpy() for k in range(n_keys)]
        new = np.zeros(rest.num_rows, bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        at = [0, *np.flatnonzero(new).tolist()]
        for s, e in zip(at, at[1:], strict=False):
            if e - s > 1:
                yield rest.slice(s, e - s).combine_chunks()
        rest = rest.slice(at[-1])
    if rest is not None and rest.num_rows > 1:
        yield rest.combine_chunks()


def _sets(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _edges(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.int64())], ["a", "b"])


def _blobs(own: list[int], toks: list[np.ndarray], bands: int):
    """A batch's shingles by band: for each band the shingles, the sets they are of, and how many of each."""
    if not own:
        return
    tok = np.concatenate(toks)
    who = np.repeat(np.arange(len(own)), [len(t) for t in toks])
    key = (mix(tok) % np.uint64(bands)).astype(np.int64) * len(own) + who
    order = np.argsort(key, kind="stable")
    tok, key = tok[order], key[order]
    u, first, count = np.unique(key, return_index=True, return_counts=True)
    band, sid = u // len(own), np.array(own)[u % len(own)]
    edge = np.append(np.flatnonzero(np.append(True, band[1:] != band[:-1])), len(band))
    rows = []
    for s, e in zip(edge.tolist(), edge[1:].tolist(), strict=False):
        f = first[s]
        rows.append((int(band[s]), tok[f : f + int(count[s:e].sum())].tobytes(), sid[s:e].tobytes(), count[s:e].astype("<u4").tobytes()))
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["band", "tok", "sid", "count"])


def shared_prefixes(docs: DataFrame) -> DataFrame:
    """sid, shared: count of prefix shingles that another set's prefix has too."""
    bands = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def emit(batches):
        seen: set[int] = set()
        for b in batches:
            own, toks = [], []
            for s in shingle_sets(b.column(0)):
                if len(s) and (sid := set_id(s)) not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(sid)
                    own.append(sid)
                    toks.append(s[: prefix(len(s))])
            yield from _blobs(own, toks, bands)

    return _meet(docs.select("text").mapInArrow(tidy(emit), BLOBS), bands, False)


def shared_wholly(sets: DataFrame) -> DataFrame:
    """sid, shared (count of a set's shingles that another of these sets has too), tokens, dfs (these and in how many sets
    each is, packed). sets: sid, items."""
    bands = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def emit(batches):
        for b in batches:
            yield from _blobs(b.column(0).to_pylist(), _sets(b.column(1)), bands)

    return _meet(sets.select("sid", "items").mapInArrow(tidy(emit), BLOBS), bands, True)


BLOBS = "band int, tok binary, sid binary, count binary"


def _meet(blobs: DataFrame, bands: int, lists: bool) -> DataFrame:
    """sid, shared and, if asked for, tokens, dfs (in how many sets each is) of the shingles that several sets have: one row
    for each set that has such shingles. Shingles meet in bands; what a band has of the sets goes back, packed, to bands
    of sets, so the rows do not depend on how many bands there are."""

    def meet(batches):
        parts: dict[int, list] = {}
        for b in batches:
            for band, tok, sid, count in zip(*(c.to_pylist() for c in b.columns), strict=True):
                parts.setdefault(band, []).append((np.frombuffer(tok, np.uint64), np.repeat(np.frombuffer(sid, np.int64), np.frombuffer(count, "<u4"))))
        for band in list(parts):
            tok, sid = (np.concatenate(x) for x in zip(*parts.pop(band), strict=True))
            order = np.argsort(tok, kind="stable")
            tok, sid = tok[order], sid[order]
            first = np.flatnonzero(np.append(True, tok[1:] != tok[:-1]))
            low, high = np.minimum.reduceat(sid, first), np.maximum.reduceat(sid, first)
            size = np.diff(np.append(first, len(tok)))
            keep, df = np.repeat(low != high, size), np.repeat(size, size)
            tok, sid, df = tok[keep], sid[keep], df[keep].astype("<u4")
            if not len(tok):
                continue
            order = np.lexsort((tok, sid))
            tok, sid, df = tok[order], sid[order], df[order]
            new = np.append(True, (tok[1:] != tok[:-1]) | (sid[1:] != sid[:-1]))
            tok, sid, df = tok[new], sid[new], df[new]
            if not lists:  # a set and a count stand for its shingles
                first = np.flatnonzero(np.append(True, sid[1:] != sid[:-1]))
                tok, df, sid = np.zeros(len(first), np.uint64), np.diff(np.append(first, len(sid))).astype("<u4"), sid[first]
            to = (mix(sid.view(np.uint64)) % np.uint64(bands)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            tok, sid, df, to = tok[order], sid[order], df[order], to[order]
            at = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])), len(to)).tolist()
            for s, e in zip(at, at[1:], strict=False):
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((int(to[s]), tok[s:e].tobytes() if lists else b"", sid[s:e].tobytes(), df[s:e].tobytes()), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["band", "tok", "sid", "count"])

    def gather(batches):
        parts: dict[int, list] = {}
        for b in batches:
            for band, tok, sid, df in zip(*(c.to_pylist() for c in b.columns), strict=True):
                parts.setdefault(band, []).append((np.frombuffer(tok, np.uint64), np.frombuffer(sid, np.int64), np.frombuffer(df, "<u4")))
        for band in list(parts):
            tok, sid, df = (np.concatenate(x) for x in zip(*parts.pop(band), strict=True))
            order = np.argsort(sid, kind="stable")
            sid, df = sid[order], df[order]
            first = np.flatnonzero(np.append(True, sid[1:] != sid[:-1]))
            if not lists:
                yield pa.RecordBatch.from_arrays([pa.array(sid[first]), pa.array(np.add.reduceat(df.astype(np.int64), first))], ["sid", "shared"])
                continue
            tok, at = tok[order], np.append(first, len(sid))
            for k in range(0, len(first), 5_000):
                s = at[k : k + 5_001]
                raw, dfs = ([c[x:y].tobytes() for x, y in zip(s[:-1].tolist(), s[1:].tolist(), strict=True)] for c in (tok, df))
                yield pa.RecordBatch.from_arrays([pa.array(sid[s[:-1]]), pa.array(np.diff(s), pa.int64()), pa.array(raw, pa.binary()), pa.array(dfs, pa.binary())], ["sid", "shared", "tokens", "dfs"])

    met = blobs.repartitionById(bands, F.col("band")).mapInArrow(tidy(meet), BLOBS)
    return met.repartitionById(bands, F.col("band")).mapInArrow(tidy(gather), "sid long, shared long" + ", tokens binary, dfs binary" * lists)


def links(docs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Edges (a, b) of set ids that connect the same sets as all links do."""
    sets_of = sizes.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    near = shared_prefixes(docs).join(sets_of, "sid")
    need = F.ceil(F.ceil(F.col("n") * 3 / 4) / 4)  # of the smallest partner
    near = written(near.where(F.col("shared") >= need).select("sid", "n", "doc_id"), "near-sets")
    homes = checked(written(near.select("doc_id").distinct(), "near-docs"))

    def whole(batches):
        for b in batches:
            got = [(set_id(s), s.tobytes()) for s in shingle_sets(b.column(0)) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([y for _, y in got], pa.binary())], ["sid", "items"])

    full = docs.join(homes, "doc_id", "left_semi").select("text").mapInArrow(tidy(whole), "sid long, items binary").groupBy("sid").agg(F.first("items").alias("items"))

    def facts(batches):
        """sid, n, items, bits, early (the two smallest shared shingles, in which most groups meet), first (the shared ones
        of the prefix when shingles stand in the order of their frequency, so that common passages come last)."""
        for b in batches:
            out = []
            for sid, n, tokens, dfs, items in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s, t, df = np.frombuffer(items, np.uint64), np.frombuffer(tokens, np.uint64), np.frombuffer(dfs, "<u4")
                take = max(0, n - three_quarters(n) + 1 - (n - len(t)))  # shingles that no other set has come first
                first = t[np.lexsort((t, df))[:take]]
                out.append((sid, n, items, bitmap(s).tobytes(), np.sort(t)[:2].view(np.int64).tolist(), first.view(np.int64).tolist()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], ["sid", "n", "items", "bits", "early", "first"])

    full = written(full, "near-items")
    # a partner holds three quarters of the set's shingles, so that many are in some other of the sets that are left
    near = near.select("sid", "n").join(shared_wholly(full), "sid").where("4 * shared >= 3 * n")
    known = written(near.select("sid", "n", "tokens", "dfs").join(full, "sid").mapInArrow(tidy(facts), "sid long, n long, items binary, bits binary, early array<long>, first array<long>"), "set-facts")

    def verified(rows: DataFrame) -> DataFrame:
        """Edges within each (key, part) of rows (key, part, sid, items)."""

        def run(batches):
            for t in _runs(batches, 2):
                yield _edges(bucket_links(t.column(2).to_pylist(), _sets(t.column(3))))

        return rows.select("key", "part", "sid", "items").repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(tidy(run), "a long, b long")

    keyed = known.select(F.explode("early").alias("key"), "sid")
    counts = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    keyed = written(keyed.join(counts, "key").select("key", "sid", F.pmod(F.xxhash64("sid"), F.ceil(F.col("c") / BLOCK)).cast("int").alias("part"), (F.col("c") > BLOCK).alias("split")), "set-buckets")
    edges = written(verified(keyed.join(known.select("sid", "items"), "sid")), "links")
    # parts of one bucket: some members of each group found so far meet again
    if keyed.where("split").limit(1).count():
        group = components(edges)
        big = keyed.where("split").join(group, F.col("sid") == F.col("node"), "left").select("key", "part", "sid", F.coalesce("root", "sid").alias("root"))
        some = big.groupBy("key", "part", "root").agg(F.expr(f"slice(array_sort(collect_set(sid)), 1, {DELEGATES})").alias("s"))
        some = some.select("key", F.lit(0).alias("part"), F.explode("s").alias("sid"))
        edges = written(edges.union(verified(some.join(known.select("sid", "items"), "sid"))), "links")

    # what still lies in several components
    group = written(components(edges), "link-groups")
    rows = known.select(F.explode("first").alias("key"), "sid").join(group, F.col("sid") == F.col("node"), "left").select("key", "sid", F.coalesce("root", "sid").alias("root"))
    open_ = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c")).where("lo < hi").select("key", F.ceil(F.col("c") / BLOCK).cast("int").alias("g"))
    rows = rows.join(open_, "key").withColumn("me", F.pmod(F.xxhash64("sid"), F.col("g")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    rows = rows.select("key", F.least("me", "other").alias("x"), F.greatest("me", "other").alias("y"), "sid", "root").join(known.select("sid", "n", "bits"), "sid")

    def candidates(batches):
        for t in _runs(batches, 3):
            sid, n = t.column(3).to_numpy(), t.column(5).to_numpy()
            order = np.lexsort((sid, n))
            sid, n = sid[order], n[order]
            bits = np.stack([np.frombuffer(x, np.uint64) for x in t.column(6).take(pa.array(order)).to_pylist()])
            root = t.column(4).to_numpy()[order]
            got = [(sid[a], sid[b], root[a], root[b]) if sid[a] < sid[b] else (sid[b], sid[a], root[b], root[a]) for a, b in SignatureTree(n, bits).pairs(Groups(root))]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*got, strict=True)], ["a", "b", "p", "q"])

    pairs = rows.select("key", "x", "y", "sid", "root", "n", "bits").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(tidy(candidates), "a long, b long, p long, q long")
    pairs = written(pairs.distinct(), "pairs")

    def confirm(batches):
        for b in batches:
            ok = [similar(p, q) for p, q in zip(_sets(b.column(2)), _sets(b.column(3)), strict=True)]
            yield b.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    def confirmed(some: DataFrame) -> DataFrame:
        left, right = (known.select(F.col("sid").alias(c), F.col("items").alias(f"{c}_items")) for c in "ab")
        return some.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "a_items", "b_items").mapInArrow(tidy(confirm), "a long, b long")

    # a few pairs of each two components tell most that belong together; then only pairs that still cross are verified
    w = W.partitionBy(F.least("p", "q"), F.greatest("p", "q")).orderBy(F.xxhash64("a", "b"))
    few = written(confirmed(pairs.withColumn("_r", F.row_number().over(w)).where(f"_r <= {PROBES}")), "links")
    label = components(few.join(pairs, ["a", "b"]).select(F.col("p").alias("a"), F.col("q").alias("b")))
    new = lambda c: F.coalesce(F.col(f"_{c}"), F.col(c))
    for c in "pq":
        pairs = pairs.join(label.select(F.col("node").alias(f"_n{c}"), F.col("root").alias(f"_{c}")), F.col(c) == F.col(f"_n{c}"), "left")
    rest = pairs.where(new("p") != new("q"))
    return edges.union(few).union(confirmed(rest))


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, sid, component_id (the smallest doc_id reachable by links, itself included), t (hash of the text)
    and group_id (the same number for all rows that links connect, null for rows without links) of every row.

    A text that is null, empty or without words has an empty set, no link and its own id as component. Rows with equal
    sets are linked, repeated rows too; a null doc_id is no candidate for a component's id unless all are null, and
    such rows are not linked to others. Very long texts are taken whole. Other columns are ignored. An empty table
    gives none.
    """
    tune(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t"))

    def measure(batches):
        for b in batches:
            got = [(len(s), set_id(s)) for s in shingle_sets(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in got], pa.int64()), pa.array([y for _, y in got], pa.int64()), b.column(2)], ["doc_id", "n", "sid", "t"])

    sizes = written(docs.mapInArrow(tidy(measure), "doc_id long, n long, sid long, t long"), "set-sizes")
    usable = sizes.where("n > 0 AND doc_id IS NOT NULL")
    group = written(components(written(links(docs.where("doc_id IS NOT NULL"), usable), "links")), "components")
    first = usable.groupBy("sid").agg(F.min("doc_id").alias("d"))
    of = first.join(group, F.col("sid") == F.col("node"), "left").select("sid", "d", F.coalesce("root", "sid").alias("root"))
    least = of.groupBy("root").agg(F.min("d").alias("component_id"))
    ids = of.join(least, "root").select("sid", "component_id", F.col("root").alias("group_id"))
    # copies of one set may be a third of all rows: only sets whose component has another id than the row are joined
    # by a key that is spread over SALTS values
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int")
    spread = ids.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    linked = usable.withColumn("salt", salt).join(spread, ["sid", "salt"]).select("doc_id", F.col("n").alias("n_shingles"), "sid", "component_id", "t", "group_id")
    lone = sizes.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), "sid", F.col("doc_id").alias("component_id"), "t", F.lit(None).cast("long").alias("group_id"))
    return linked.unionByName(lone)
