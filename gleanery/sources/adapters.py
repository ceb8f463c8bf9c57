"""The test tables in the shapes of a knowledge store: documents, contents, vectors, registry rows, slugs, links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2024-01-01 00:00:00 UTC
EPOCH = 1704067200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, collection, path, title, hash, doc, modified (epoch seconds), active."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        F.col("source").alias("collection"),
        F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.substring_index("text", " ", 4).alias("title"),
        F.sha2("text", 256).alias("hash"),
        F.col("text").alias("doc"),
        (F.col("doc_id") + EPOCH).alias("modified"),
        (F.col("doc_id") % 10 != 3).alias("active"),
    )


#: The same rows in SQL, as a common table expression body.
DOCUMENTS_SQL = f"""SELECT doc_id, source AS collection, lang || '/' || doc_id || '.md' AS path,
 array_to_string(string_split(text, ' ')[1:4], ' ') AS title, sha256(text) AS hash, text AS doc, doc_id + {EPOCH} AS modified, doc_id % 10 <> 3 AS active FROM documents"""
