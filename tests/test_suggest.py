"""Suggestions on a small history, each rule by a case."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.operators import suggest
from gleanery.operators.knowledge import signature

HISTORY = [("a", 1, "risk-management"), ("a", 1, "scope-management"), ("b", 1, "risk-management"), ("b", 2, "cost-management"), ("c", 1, "tax-planning"), ("a", 1, "project-control")]
NEW = [("n", 3, f"project-plan-{x}") for x in ("one", "two", "three")] + [("n", 3, "project-control"), ("n", 3, "quality-management")]
SCHEMA = "source string, at int, slug string"


def rows(spark, barred=(), builtin=(), cutoff=0.0):
    h, n = spark.createDataFrame(HISTORY, SCHEMA), spark.createDataFrame(NEW, SCHEMA)
    no = spark.createDataFrame([(b,) for b in barred], "id string")
    return {r.umbrella: r for r in suggest.detected(h, n, no, spark.createDataFrame([(b,) for b in builtin], "slug string"), cutoff).collect()}


def test_detected(spark):
    got = rows(spark)
    assert set(got) == {"cluster-management", "project-control", "project"}
    m = got["cluster-management"]
    assert m.slugs == ["cost-management", "quality-management", "risk-management", "scope-management"] and (m.support, m.mentions) == (3, 5)
    assert round(m.confidence, 6) == round(0.4 * 3 / 5 + 0.3 + 0.2 * 5 / 20 + 0.1, 6)
    assert got["project"].slugs == sorted(["project-plan-one", "project-plan-two", "project-plan-three", "project-control"]) and got["project"].support == 1
    assert set(rows(spark, cutoff=0.6)) == {"cluster-management"} and set(rows(spark, barred=[m.id])) == {"project-control", "project"}
    assert round(rows(spark, builtin=["risk-management"])["cluster-management"].confidence, 6) == round(m.confidence - 0.1, 6)
    one = spark.range(1).select(signature(F.lit("cluster-management"), F.array(*[F.lit(s) for s in m.slugs])).alias("s")).first().s
    assert m.id == one


def test_history_once(spark):
    h, n = spark.createDataFrame(HISTORY, SCHEMA), spark.createDataFrame([*NEW, ("a", 1, "never")], SCHEMA)
    out = suggest.appended(h, n)
    assert out.count() == len(HISTORY) + len(NEW) and out.where("slug = 'never'").count() == 0
    assert suggest.appended(out, n).count() == out.count()
