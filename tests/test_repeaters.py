"""Frequent acronyms against the SQL, on letters whose capitals are several letters, none or ASCII."""

from __future__ import annotations

from oracle import compare

from gleanery import catalog
from gleanery.plans import context_queries


def odd(spark, tmp_path, name: str, columns: str, rows: list) -> None:
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        df = spark.createDataFrame(rows, columns) if t == name else spark.range(0)
        df.coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")


TEXTS = ["muß muß MUSS muss muſs ın in", "ofﬁ ofﬁ ofﬁ ﬁ ﬁ ﬁ a1 A1 a1", "groß.groß,groß; und und Und ab  ab  ab ", "ıd Id id ǰa ǰa ǰa", None, ""]


def test_capitals_one_for_one(spark, tmp_path):
    odd(spark, tmp_path, "documents", "doc_id long, text string", [(k, t and f"{t} {t} {t}") for k, t in enumerate(TEXTS)])
    compare(spark, str(tmp_path), catalog.queries()["global_repeaters"], catalog.oracle_sql()["global_repeaters"])


def test_peers(spark, tmp_path):
    odd(spark, tmp_path, "conversations", "conv_id long, turn int, role string, text string", [(1, k, "user", t and f"{t} {t} {t}") for k, t in enumerate(TEXTS)])
    compare(spark, str(tmp_path), context_queries.Q["peer_context"], context_queries.SQL["peer_context"])
