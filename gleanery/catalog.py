"""All queries over the test tables, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleanery.plans import context_queries, knowledge_queries, store_queries, upkeep_queries

PARTS = [store_queries, knowledge_queries, upkeep_queries, context_queries]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_queries.bm25_search(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for p in PARTS for k, f in p.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for p in PARTS for k, s in p.SQL.items()}
