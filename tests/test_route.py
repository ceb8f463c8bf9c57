"""Routes of texts at the limit of a context, against the SQL and by the plain rule."""

from __future__ import annotations

from oracle import compare
from pyspark.sql import functions as F
from test_repeaters import odd

from gleanery import catalog
from gleanery.functions import text as T


def test_limit(spark, tmp_path):
    odd(spark, tmp_path, "documents", "doc_id long, text string", [(n, "x" * n) for n in range(3915, 3940)])
    compare(spark, str(tmp_path), catalog.queries()["lang_hint"], catalog.oracle_sql()["lang_hint"])
    plain = spark.range(1276, 1279).select(T.route(F.col("id"), 4096))  # 1276.8 tokens are usable
    assert [r[0] for r in plain.collect()] == ["FULL", "SEGMENTED", "SEGMENTED"]
