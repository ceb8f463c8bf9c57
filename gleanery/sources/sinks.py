"""Writers and result formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import escape_csv, escape_xml


def formatted(results: DataFrame, kind: str) -> DataFrame:
    """One text for each result (path, title, score, body) as json, csv, files, md or xml."""
    score: Column = F.round("score", 2)
    if kind == "json":
        out = F.to_json(F.struct("path", "title", score.alias("score"), "body"))
    elif kind == "csv":
        out = F.concat_ws(",", escape_csv(F.col("path")), escape_csv(F.col("title")), F.format_string("%.4f", "score"))
    elif kind == "files":
        out = F.col("path")
    elif kind == "md":
        out = F.concat(F.lit("## "), "title", F.lit("\n\n`"), "path", F.lit("`\n\n"), "body")
    elif kind == "xml":
        out = F.concat(F.lit('<file path="'), escape_xml(F.col("path")), F.lit('" score="'), score.cast("string"), F.lit('">'), escape_xml(F.col("body")), F.lit("</file>"))
    else:
        raise ValueError(f"no such format: {kind}")
    return results.select("path", out.alias("text"))


def pages(df: DataFrame, path: str) -> None:
    """Writes pages (category, filename, content) by category; names that leave the folder are refused."""
    if df.where(F.contains("filename", F.lit(".."))).limit(1).count():
        raise ValueError("a page's name leaves its folder")
    df.write.mode("overwrite").partitionBy("category").parquet(path)


def compact(df: DataFrame, path: str, files: int) -> None:
    df.coalesce(files).write.mode("overwrite").parquet(path)
