"""Every query of the knowledge store against its SQL on whole tables; queries without SQL give rows."""

from __future__ import annotations

import pytest
from oracle import compare

from gleanery import catalog

SF = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    compare(spark, SF, catalog.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
