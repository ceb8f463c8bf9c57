"""Embedding whitening by one-sided Jacobi SVD.

Each task reduces its block of centred rows to the triangular R of a QR factorisation; R's are stacked and factorised
again in a tree (TSQR). The last R has the size of the dimension, whatever the number of rows, and the same right singular
vectors as all rows together. Plane rotations make its columns orthogonal; their product holds the components, the columns'
norms are the singular values, so small ones keep their relative accuracy, which squaring into a covariance would cost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import discard, tidy, tune, written

#: R's that one task of the tree stacks at most.
FAN = 16
#: Rows of a block that is factorised at once: at most so many, times the dimension.
BLOCK = 8
#: Entries beyond this have no long as 1024 times themselves, and count as not finite.
LARGEST = 2.0**52
#: Singular values up to this share of the largest count as zero; their components do not exist.
RANK = 1e-10


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector has entries, none of them null, not finite or too large."""
    v = F.col(column)
    return vectors.where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) <= LARGEST, F.lit(False))))


def codes(column: pa.Array, dim: int) -> np.ndarray:
    """floor(1024 c) + 100000 of each entry, a row for each vector."""
    return np.floor(1024 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64).reshape(-1, dim) + 100_000


def counted(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """dim, low, high of this task's sums: sum = high * 2**31 + low, so that no sum of longs can overflow."""
    low, high = np.zeros(dim, np.int64), np.zeros(dim, np.int64)
    for b in batches:
        x = codes(b.column(0), dim)
        low += (x & 0x7FFFFFFF).sum(0)
        high += (x >> 31).sum(0)
        high += low >> 31
        low &= 0x7FFFFFFF
    yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(low), pa.array(high)], ["dim", "low", "high"])


@dataclass(frozen=True)
class Centre:
    """Number of vectors and the exact sum of their codes in each dimension."""

    n: int
    sums: tuple[int, ...]

    @property
    def dim(self) -> int:
        return len(self.sums)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: longs where they fit, else Python's integers."""
        s = np.array(self.sums, object)
        if len(x) and self.n * int(np.abs(x).max()) + max(abs(v) for v in self.sums) >= 1 << 63:
            return x.astype(object) * self.n - s
        return x * np.int64(self.n) - s.astype(np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x).astype(np.float64) / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2, exact; null where it does not fit a long."""
        d = self.scaled(x)
        if d.dtype != object and len(d) and int(np.abs(d).max()) ** 2 * self.dim < 1 << 63:
            return (d * d).sum(1).tolist()
        return [v if v < 1 << 63 else None for v in (sum(int(y) * int(y) for y in row) for row in d)]


def packed(r: np.ndarray) -> bytes:
    return np.ascontiguousarray(r, "<f8").tobytes()


def unpacked(b: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(b, "<f8").reshape(-1, dim)


def triangle(blocks: Iterator[np.ndarray], dim: int) -> np.ndarray:
    """R of all blocks of rows; memory is that of one block of BLOCK * dim rows."""
    r = np.zeros((0, dim))
    for b in blocks:
        for k in range(0, len(b), BLOCK * dim):
            r = np.linalg.qr(np.concatenate([r, b[k : k + BLOCK * dim]]), mode="r")
    return r


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of r, falling, and its right singular vectors as rows.

    Each step of a sweep rotates disjoint pairs of columns (a round-robin, so each pair meets once a sweep), until all pairs
    are orthogonal to double precision."""
    dim = r.shape[1]
    even = dim + dim % 2
    u, v = np.zeros((len(r), even)), np.eye(even)
    u[:, :dim] = r
    least = 4 * np.finfo(float).eps * np.sqrt(len(r) + 1)
    ring = np.arange(1, even)
    for _ in range(sweeps):
        turned = False
        for k in range(even - 1):
            seats = np.append(0, np.roll(ring, k))
            i, j = seats[: even // 2], seats[::-1][: even // 2]
            a, b = u[:, i], u[:, j]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            on = np.abs(ab) > least * np.sqrt(aa * bb)
            if not on.any():
                continue
            turned = True
            i, j, aa, bb, ab = i[on], j[on], aa[on], bb[on], ab[on]
            z = (bb - aa) / (2 * ab)
            t = np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.hypot(1, z))
            c = 1 / np.hypot(1, t)
            s = c * t
            for m in (u, v):
                x, y = m[:, i], m[:, j]
                m[:, i], m[:, j] = c * x - s * y, s * x + c * y
        if not turned:
            break
    norm = np.sqrt((u * u).sum(0))
    order = np.argsort(-norm, kind="stable")[:dim]  # an odd dimension's empty column is the last of equals
    parts = v.T[order][:, :dim]
    top = np.abs(parts).argmax(1)
    return norm[order], parts * np.where(parts[np.arange(len(parts)), top] < 0, -1.0, 1.0)[:, None]


def reduced(rows: DataFrame, centre: Centre) -> np.ndarray:
    """The R of all centred rows. Levels of the tree are written tables, so a lost executor costs one level's tasks; what
    comes to the driver is at most FAN triangles of the vectors' dimension."""
    dim = centre.dim
    schema = "part long, r binary"

    def leaf(batches):
        from pyspark import TaskContext

        r = triangle((centre.centred(codes(b.column(0), dim)) for b in batches), dim)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([packed(r)], pa.binary())], ["part", "r"])

    def merge(key, group):  # at most FAN rows
        r = triangle((unpacked(x, dim) for x in group.column("r").to_pylist()), dim)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "r": pa.array([packed(r)], pa.binary())})

    level = written(rows.mapInArrow(tidy(leaf), schema), "triangles")
    while (level.agg(F.max("part")).first()[0] or 0) >= FAN:
        up = written(level.groupBy(F.floor(F.col("part") / FAN).alias("g")).applyInArrow(merge, schema), "triangles")
        discard(level)
        level = up
    got = triangle((unpacked(bytes(x.r), dim) for x in sorted(level.collect())), dim)
    discard(level)
    return got


@dataclass(frozen=True)
class Whitening:
    """A fitted basis: rows of `parts` are components, `deviations` their standard deviations, falling; `total` is the
    trace of the covariance."""

    centre: Centre
    parts: np.ndarray
    deviations: np.ndarray
    total: float

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.parts.T / self.deviations


def commonest_size(vectors: DataFrame, column: str) -> int:
    """The length that most vectors have, the greater one of equals; 0 without vectors."""
    top = vectors.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return top.d if top else 0


def fit(vectors: DataFrame, column: str = "embedding", most: int = 8) -> Whitening | None:
    """Basis of up to `most` components over all usable vectors of the commonest length; fewer where the vectors span less.
    None without vectors. Two passes: exact sums, then TSQR. The driver holds numbers by dimension alone."""
    tune(vectors.sparkSession)
    rows = usable(vectors.select(column), column)
    dim = commonest_size(rows, column)
    if not dim:
        return None
    rows = rows.where(F.size(column) == dim)
    sums = rows.mapInArrow(tidy(lambda batches: counted(batches, dim)), "dim int, low long, high long")
    sums = sums.groupBy("dim").agg(F.sum(F.col("low").cast("decimal(38,0)") + F.col("high").cast("decimal(38,0)") * (1 << 31)).alias("s")).collect()
    by = {r.dim: int(r.s) for r in sums}
    centre = Centre(rows.count(), tuple(by[k] for k in range(dim)))
    values, parts = jacobi(reduced(rows, centre))
    keep = int((values[:most] > RANK * max(values[0], 1e-300)).sum()) if len(values) else 0
    return Whitening(centre, parts[:keep], values[:keep] / np.sqrt(centre.n), float((values**2).sum()) / centre.n)


def identity_error(rows: DataFrame, basis: Whitening, column: str = "embedding") -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, measured in one more pass: moments
    are summed up by task, and then by Spark."""
    k, dim = len(basis.parts), basis.centre.dim

    def run(batches):
        one, two = np.zeros(k), np.zeros((k, k))
        for b in batches:
            w = basis.project(codes(b.column(0), dim))
            one += w.sum(0)
            two += w.T @ w
        at = [(i, j) for i in range(k + 1) for j in range(k)]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in at], pa.int32()), pa.array([j for _, j in at], pa.int32()), pa.array([float(one[j] if i == k else two[i, j]) for i, j in at])], ["i", "j", "s"])

    got = rows.select(column).mapInArrow(tidy(run), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    m = np.zeros((k + 1, k))
    for r in got:
        m[r.i, r.j] = r.s / basis.centre.n
    return float(np.abs(m[:k] - np.outer(m[k], m[k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", most: int = 8) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component.

    Left out are null and empty vectors, those with a null, not finite or too large entry (over 2^52), and those of another
    length than most vectors have. Repeated rows and null keys stay, each row counts. Equal eigenvalues give any basis of
    their space. Components with a standard deviation of nothing (rank of the vectors, or all vectors equal) do not exist, so
    fewer than `most` may come, or none. A deviation that does not fit a long is null. An empty table gives none; other
    columns are ignored, whatever their names."""
    spark = vectors.sparkSession
    schema = f"`{key}` {vectors.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    basis = fit(vectors, column, most)
    if basis is None or not len(basis.parts):
        return spark.createDataFrame([], schema)
    dim, k, n = basis.centre.dim, len(basis.parts), basis.centre.n
    rows = usable(vectors.select(key, column), column).where(F.size(column) == dim)
    error = identity_error(rows, basis, column)
    explained = basis.deviations**2 / basis.total

    def run(batches):
        for b in batches:
            x = codes(b.column(1), dim)
            size, each = len(x), np.repeat(np.arange(len(x)), k)
            deviation = pa.array(basis.centre.deviation(x), pa.int64())
            cols = [b.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)), pa.array(np.full(size * k, n)), deviation.take(pa.array(each)), pa.array(basis.project(x).ravel()), pa.array(np.tile(explained, size)), pa.array(np.full(size * k, error))]
            yield pa.RecordBatch.from_arrays(cols, [key, *"component n deviation whitened explained identity_error".split()])

    return rows.mapInArrow(tidy(run), schema)
