"""Folders that driver and executors share, and stamps of inputs that tell whether something kept still belongs to them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder under spark.checkpoint.dir. Only a session of one process may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        base = _OWN.setdefault("base", "file://" + tempfile.mkdtemp(prefix="gleanery-"))
    if not base:
        raise ValueError("spark.checkpoint.dir is not set: kept tables need a folder that all executors share")
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder that is used up."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stamp(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Files, bytes and the newest change under a path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True)
    n = size = newest = 0
    while files.hasNext():
        f = files.next()
        n, size, newest = n + 1, size + f.getLen(), max(newest, f.getModificationTime())
    return n, size, newest


def written(df, tag: str):
    """df as a Parquet table in the shared folder, so that what follows does not compute it again."""
    path = shared_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
