"""Token-ID output as a content-addressed store.

Layout of a store folder, all Parquet:
  kind=chunk    key (SHA-256 of data), data (ids as little-endian unsigned 16- or 32-bit integers), width, n
  kind=recipe   doc_id, n_tokens, root, digests (the keys of the document's chunks in order, 32 bytes each)
  order/        the recipes in ascending doc_id order, dealt to parts: part, pos, doc_id, n_tokens, root, digests
  manifest/     part, n_docs, n_tokens, start (ids of all parts before), root (Merkle root over the part's recipes: doc_id,
                n_tokens and root of each, in order)
A rolling hash over the last WINDOW ids cuts a stream where its low bits are zero, so equal passages give equal chunks
wherever they stand. A chunk's bytes are written once.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.llm.common import kept, pieces, shared_dir, texts, tidy, tune
from gleanery.llm.segments import DIGIT, LETTER, NEWLINE, PUNCT, SPACE, SegmentCache, classes, cuts_to_segments

WINDOW, LEAST, MOST, MASK = 16, 128, 4096, 1023
#: Most chunk keys that a task remembers to send equal chunks' bytes only once.
SEEN = 200_000
SPECIAL = b"<|endoftext|>"


class ByteEncoder:
    """Ids of whole texts as tokenizers' encode(text, add_special_tokens=False) gives them, for byte-level BPE files
    with the usual letter/number/other pre-tokens and no prefix space. Each distinct segment is encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.width = 2 if self.lib.get_vocab_size() <= 1 << 16 else 4
        (self.newline,) = self.lib.encode("\n", add_special_tokens=False).ids
        self.cache = SegmentCache(self.encode_many)

    def encode_many(self, segments: list[bytes]) -> list[list[int]]:
        """Segments without newline are encoded together, parted by newlines, which are pre-tokens of their own
        between two segments whose ends are no white space; others one by one."""
        out: list = [None] * len(segments)
        words = [(k, s.decode("utf-8")) for k, s in enumerate(segments)]
        plain = [(k, s) for k, s in words if "\n" not in s and s.isascii() and s.strip() and s[-1] > " " and s.lstrip(" ")[0] > " " and "<|" not in s and s[:2] != "  "]
        for at in range(0, len(plain), 1000):
            part = plain[at : at + 1000]
            ids, start, got = self.lib.encode("\n".join(s for _, s in part), add_special_tokens=False).ids, 0, []
            for p in [*(i for i, x in enumerate(ids) if x == self.newline), len(ids)]:
                got.append(ids[start:p])
                start = p + 1
            if len(got) == len(part):
                for (k, _), x in zip(part, got, strict=True):
                    out[k] = x
        for k, s in words:
            if out[k] is None:
                out[k] = self.lib.encode(s, add_special_tokens=False).ids
        return out

    def segments(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cut before a space between two other known characters, around a newline between such, and between a letter
        and punctuation: there a pre-token ends in any text. A text with a special token's string is not cut."""
        if not len(buf):
            return (np.zeros(0, np.int64),) * 3
        cls = classes(buf)
        solid = (cls == LETTER) | (cls == PUNCT) | (cls == DIGIT)
        cut = np.zeros(len(buf), bool)
        if len(buf) > 2:
            cut[1:-1] = (cls[1:-1] == SPACE) & solid[:-2] & solid[2:]
            line = (cls[1:-1] == NEWLINE) & solid[:-2] & solid[2:]
            cut[1:-1] |= line
            cut[2:] |= line
            cut[1:] |= (cls[:-1] == LETTER) & (cls[1:] == PUNCT)
        at = buf.tobytes().find(SPECIAL)
        while at >= 0:
            d = int(np.searchsorted(offs, at, "right")) - 1
            cut[offs[d] : offs[d + 1]] = False
            at = buf.tobytes().find(SPECIAL, int(offs[d + 1]))
        return cuts_to_segments(cut, offs)

    def encode(self, column: pa.Array, end: int):
        """For runs of texts: all ids with the end id of each text, and the ids of each text."""
        for i, j, buf, offs in pieces(*texts(column)):
            starts, ends, doc = self.segments(buf, offs)
            flat, lens = self.cache.get(buf, starts, ends) if len(starts) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            n = np.bincount(doc, lens, j - i).astype(np.int64) if len(doc) else np.zeros(j - i, np.int64)
            out = np.full(len(flat) + j - i, end, np.uint32)
            put = np.ones(len(out), bool)
            put[np.cumsum(n + 1) - 1] = False
            out[put] = flat
            yield out, n + 1


def cut_points(ids: np.ndarray, n: np.ndarray) -> list[list[int]]:
    """Chunk ends of each text, from its start: at rolling-hash cuts, at least LEAST and at most MOST ids apart."""
    gear = kept("gear", lambda: np.random.default_rng(5).integers(0, 1 << 63, 1 << 16, np.uint64))
    g = gear[ids & np.uint32(0xFFFF)]
    h = np.zeros(len(ids), np.uint64)
    for k in range(min(WINDOW, len(ids))):
        h[k:] += g[: len(g) - k] << np.uint64(2 * k)
    marks = np.flatnonzero((h >> np.uint64(40)) & np.uint64(MASK) == 0) + 1
    out, base = [], 0
    for m in n.tolist():
        own = (marks[np.searchsorted(marks, base + LEAST) : np.searchsorted(marks, base + m)] - base).tolist() if m > LEAST else []
        ends, last = [], 0
        for e in [*own, m]:
            while e - last > MOST:
                last += MOST
                ends.append(last)
            if e == m or e - last >= LEAST:
                ends.append(e)
                last = e
        out.append(ends)
        base += m
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd last node moves up as it is. No leaves: the hash of nothing."""
    level = list(leaves) or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[k] + level[k + 1]).digest() if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


STAGED = "kind string, key binary, data binary, width int, n int, doc_id long, n_tokens long, root binary, digests binary"


ORDER = "part int, pos long, doc_id long, n_tokens long, root binary, digests binary"
PARTS = "part int, n_docs long, n_tokens long, root binary"


def part_roots(ordered: DataFrame) -> DataFrame:
    """PARTS of each part of the order: the root of the Merkle tree whose leaves are its recipes in order."""

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            for part, doc, n, root in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                a = held.setdefault(part, [0, []])
                a[0] += n
                a[1].append(hashlib.sha256(b"%s %d " % (str(doc).encode(), n) + root).digest())
        rows = [(p, len(leaves), n, merkle(leaves)) for p, (n, leaves) in held.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "n_docs", "n_tokens", "root"])

    return ordered.select("part", "doc_id", "n_tokens", "root", "pos").repartition("part").sortWithinPartitions("part", "pos").mapInArrow(tidy(run), PARTS)


def audit(spark: SparkSession, path: str) -> DataFrame:
    """part, base (ids before it), n_tokens, there, sound of each part of the manifest or of the order: whether it is in
    the order, and whether its recipes, their number, sequence and ids are those of the manifest's root and counts."""
    want = spark.read.schema(f"{PARTS}, start long").parquet(f"{path}/manifest")
    has = part_roots(spark.read.schema(ORDER).parquet(f"{path}/order")).select("part", *[F.col(c).alias(f"_{c}") for c in ("n_docs", "n_tokens", "root")])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("n_docs", "n_tokens", "root")]
    both = want.join(has, "part", "full")
    return both.select("part", F.coalesce("start", F.lit(0)).alias("base"), "n_tokens", F.col("_root").isNotNull().alias("there"), (same[0] & same[1] & same[2]).alias("sound"))


def write_store(docs: DataFrame, tokenizer: str, path: str, end: int = 2) -> str:
    """Writes the store of docs (doc_id, text) to path, a folder that executors share, and returns path.

    Null text counts as empty (only the end id); null doc_ids come first; repeated rows and equal doc_ids each have
    their recipe, in the order of their roots; other columns are ignored; an empty table gives empty tables. Bytes are
    shuffled once, by chunk key, and not again for a chunk that the same task has sent.
    """
    tune(docs.sparkSession)
    width = ByteEncoder(tokenizer).width

    def run(batches):
        from pyspark import TaskContext

        enc = kept(("byte-encoder", tokenizer), lambda: ByteEncoder(tokenizer))
        seen, task, row = set(), TaskContext.get().partitionId(), 0
        dtype = "<u2" if enc.width == 2 else "<u4"
        for b in batches:
            ids_of = b.column(0).to_pylist()
            k = 0
            for out, n in enc.encode(b.column(1), end):
                rows, packed, base = [], out.astype(dtype).tobytes(), 0
                for m, ends in zip(n.tolist(), cut_points(out, n), strict=True):
                    keys, last = [], 0
                    for e in ends:
                        data = packed[(base + last) * enc.width : (base + e) * enc.width]
                        keys.append(key := hashlib.sha256(data).digest())
                        if key not in seen:
                            if len(seen) >= SEEN:
                                seen.clear()
                            seen.add(key)
                            rows.append(("chunk", key, data, enc.width, e - last, None, None, None, None))
                        last = e
                    rows.append(("recipe", hashlib.sha256(b"%d %d" % (task, row)).digest(), None, None, None, ids_of[k], m, merkle(keys), b"".join(keys)))
                    row, k, base = row + 1, k + 1, base + m
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], STAGED.replace(",", "").split()[::2])

    def once(batches):
        last = None
        for b in batches:
            key = b.column(1)
            if not len(key):
                continue
            same = pc.equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)
            keep = np.append(key[0].as_py() != last, ~same.astype(bool))
            last = key[len(key) - 1].as_py()
            yield b.filter(pa.array(keep))

    staged = docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(tidy(run), STAGED)
    staged = staged.repartition("key").sortWithinPartitions("kind", "key").mapInArrow(tidy(once), STAGED)
    staged.write.option("compression", "zstd").partitionBy("kind").parquet(path)
    spark = docs.sparkSession
    empty = spark.createDataFrame([], STAGED)
    for kind in ("chunk", "recipe"):  # an empty input leaves no folders
        if not spark._jvm.org.apache.hadoop.fs.Path(f"{path}/kind={kind}").getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/kind={kind}")):
            empty.drop("kind").write.parquet(f"{path}/kind={kind}")
    recipes = spark.read.schema(STAGED).parquet(f"{path}/kind=recipe").select("doc_id", "n_tokens", "root", "digests")
    ordered = recipes.repartitionByRange("doc_id", "root").sortWithinPartitions("doc_id", "root")
    w = W.partitionBy("part").orderBy("doc_id", "root", "pos")
    ordered = ordered.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos"), "*")
    ordered.write.option("compression", "zstd").parquet(f"{path}/order")
    ordered = spark.read.schema(ORDER).parquet(f"{path}/order")

    parts = part_roots(ordered)
    # one row for each part of the order: as many as shuffle partitions, not as documents
    start = F.coalesce(F.sum("n_tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts.withColumn("start", start).write.parquet(f"{path}/manifest")
    return path


def _crc_table() -> list[list[int]]:
    """Columns of the operators that append 2**k zero bytes to a message of which a CRC-32 is known."""
    odd = [0xEDB88320, *(1 << k for k in range(31))]  # one zero bit

    def times(m, v):
        s, k = 0, 0
        while v:
            if v & 1:
                s ^= m[k]
            v, k = v >> 1, k + 1
        return s

    square = lambda m: [times(m, c) for c in m]
    m = square(square(square(odd)))
    out = [m]
    for _ in range(31):
        out.append(square(out[-1]))
    return out


def crc_join(a: int, b: int, n: int) -> int:
    """CRC-32 of two messages joined, from both CRCs and the second's length in bytes."""
    ops, k = kept("crc-ops", _crc_table), 0
    while n:
        if n & 1:
            s, v, c = 0, a, 0
            m = ops[k]
            while v:
                if v & 1:
                    s ^= m[c]
                v, c = v >> 1, c + 1
            a = s
        n, k = n >> 1, k + 1
    return a ^ b


def chunk_digests(spark: SparkSession, path: str) -> DataFrame:
    """key, n, crc, sound of every stored chunk, from its bytes: CRC-32 of its ids as 32-bit integers, and whether the
    bytes hash to the key."""

    def run(batches):
        for b in batches:
            rows = []
            for key, data, width, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = np.frombuffer(data, "<u2" if width == 2 else "<u4")
                rows.append((key, n, zlib.crc32(ids.astype("<u4").tobytes()), hashlib.sha256(data).digest() == key and len(ids) == n))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int32(), pa.int64(), pa.bool_()), strict=True)], ["key", "n", "crc", "sound"])

    chunks = spark.read.schema(STAGED).parquet(f"{path}/kind=chunk").select("key", "data", "width", "n")
    return chunks.mapInArrow(tidy(run), "key binary, n int, crc long, sound boolean")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """part, pos, doc_id, n_tokens, root, i, key of each recipe's chunks."""
    order = spark.read.schema(ORDER).parquet(f"{path}/order")
    at = F.posexplode(F.sequence(F.lit(0), (F.octet_length("digests") / 32).cast("int") - 1)).alias("i", "k")
    return order.select("part", "pos", "doc_id", "n_tokens", "root", "digests", at).select("part", "pos", "doc_id", "n_tokens", "root", "i", F.substring(F.col("digests"), F.col("k") * 32 + 1, F.lit(32)).alias("key"))


def verify(spark: SparkSession, path: str) -> DataFrame:
    """part, pos, doc_id, start, n_tokens, ids_crc32, verified of each document, read back from the files.

    verified: every chunk is there and hashes to its key, the keys give the recipe's Merkle root, the ids are as many as
    the recipe says, and the recipes of its part give the manifest's Merkle root and counts, so a recipe that is missing,
    put in or moved shows in all rows of its part. A part of the manifest without any recipe is one row without doc_id,
    not verified. Chunk bytes are read where they are stored; only digests of them are joined to recipes.
    """
    tune(spark)
    got = _lines(spark, path).join(chunk_digests(spark, path), "key", "left")
    docs = got.groupBy("part", "pos").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.first("root").alias("root"), F.sort_array(F.collect_list(F.struct("i", "key", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("crc", F.lit(0)).alias("crc"), F.coalesce("sound", F.lit(False)).alias("sound")))).alias("l")
    )

    def run(batches):
        for b in batches:
            crcs, sound = [], []
            for want, root, l in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
                crc = 0
                for x in l:
                    crc = crc_join(crc, x["crc"], 4 * x["n"])
                crcs.append(crc)
                sound.append(all(x["sound"] for x in l) and sum(x["n"] for x in l) == want and merkle([x["key"] for x in l]) == root)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(crcs, pa.int64()), pa.array(sound, pa.bool_())], ["part", "pos", "doc_id", "n_tokens", "ids_crc32", "verified"])

    docs = docs.mapInArrow(tidy(run), "part int, pos long, doc_id long, n_tokens long, ids_crc32 long, verified boolean")
    known = audit(spark, path)
    w = W.partitionBy("part").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    # the audit has one row for each part, so it may be broadcast
    out = docs.join(F.broadcast(known.select("part", "base", "sound")), "part").withColumn("start", F.col("base") + F.coalesce(F.sum("n_tokens").over(w), F.lit(0)))
    out = out.select("part", "pos", "doc_id", "n_tokens", "ids_crc32", (F.col("verified") & F.col("sound")).alias("verified"), "start")
    lost = known.where(~F.col("there")).select("part", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("long").alias("doc_id"), "n_tokens", F.lit(None).cast("long").alias("ids_crc32"), F.lit(False).alias("verified"), F.col("base").alias("start"))
    return out.unionByName(lost)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, pos, ids: every document put together from its chunks, verified; raises on a document that is not sound, and
    on an order that is not the manifest's."""
    if audit(spark, path).where("NOT sound").limit(1).count():
        raise ValueError("the recipes are not those of the manifest")
    chunks = spark.read.schema(STAGED).parquet(f"{path}/kind=chunk").select("key", "data", "width")
    docs = _lines(spark, path).join(chunks, "key", "left").groupBy("part", "pos").agg(F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.first("root").alias("root"), F.sort_array(F.collect_list(F.struct("i", "key", "data", "width"))).alias("l"))

    def run(batches):
        for b in batches:
            ids = []
            for want, root, l in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
                if any(x["data"] is None or hashlib.sha256(x["data"]).digest() != x["key"] for x in l) or merkle([x["key"] for x in l]) != root:
                    raise ValueError("a document's chunks do not match its recipe")
                ids.append(np.concatenate([np.frombuffer(x["data"], "<u2" if x["width"] == 2 else "<u4").astype(np.int64) for x in l]))
                if len(ids[-1]) != want:
                    raise ValueError("a document's ids are not as many as its recipe says")
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(1), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "pos", "ids"])

    return docs.mapInArrow(tidy(run), "doc_id long, pos long, ids array<long>")


def store(docs: DataFrame, tokenizer: str, end: int = 2) -> str:
    """write_store to a new shared folder."""
    return write_store(docs, tokenizer, shared_dir(docs.sparkSession, "token-store"), end)
