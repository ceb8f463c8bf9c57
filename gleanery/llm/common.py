"""Tables, shared work folders and small helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession

#: Rows of an Arrow batch that is sent to Python; texts average a few kB, so a batch stays at a few MB.
BATCH_ROWS = 1000
#: Bytes of an Arrow batch, whatever the number of its rows.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows and bytes; texts of any length then need a few MB of memory at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share. Without that setting there is no place
    that all of them see, so it must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        base = "file://" + kept("single-process-folder", lambda: tempfile.mkdtemp(prefix="gleanery-"))  # one process is the whole cluster
    if not base:
        raise ValueError("spark.checkpoint.dir is not set: tables between steps need a folder that all executors share")
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """Cuts lineage: df as a Parquet table in the shared folder. It outlives lost executors."""
    path = shared_dir(df.sparkSession, tag)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the folders of written tables, once what was made of them is written itself."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def kept(key: object, make):
    """What make() returned first in this Python process; functions that are pickled by value have no module state."""
    store = sys.modules.setdefault("_gleanery_kept", types.ModuleType("_gleanery_kept")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def trim() -> None:
    """Gives memory that is free back to the system; a reused Python worker would keep what its largest task took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """run, a generator function of mapInArrow, that trims after its last batch."""

    @functools.wraps(run)
    def whole(batches):
        yield from run(batches)
        trim()

    return whole


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and len(offs) > 1 else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def pieces(buf: np.ndarray, offs: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a column into runs of whole texts of about `most` bytes: first text, end, bytes, offsets."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


#: Bytes of a broadcast side's values; beyond that, a shuffle join.
BROADCAST_BYTES = 32 << 20


def _width(name: str, kind) -> Column:
    """Bytes of a column's value; nested values by their elements."""
    from pyspark.sql import functions as F

    c, kind = F.col(f"`{name}`"), kind.simpleString()
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    return F.coalesce(F.size(c), F.lit(0)) * 16 + 16 if kind.startswith(("array", "map")) else F.lit(32 if kind.startswith("struct") else 8)


def checked(side: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """side, a written table, with a broadcast hint if its values take at most `most` bytes."""
    from pyspark.sql import functions as F

    total = side.agg(F.sum(sum((_width(f.name, f.dataType) for f in side.schema), F.lit(8)).cast("long"))).first()[0]
    return F.broadcast(side) if (total or 0) <= most else side
