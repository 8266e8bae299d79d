"""Every registered query of the engine against its SQL, and the entry points."""

from __future__ import annotations

import pytest

import __spark_entry__
from tests.oracle import normal, sql_rows
from tracewell.plans import catalog

SKIP_SQL = set()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, small, name):
    got = catalog.QUERIES[name](spark, small).toPandas()
    if name not in catalog.ORACLE_SQL:
        assert len(got) > 0
        return
    want = sql_rows(catalog.ORACLE_SQL[name], small)
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["inv", "status", "n_conflicts", "n_core", "corroborated", "from_id", "to_id", "observed_at", "earlier_unresolved"]
    assert rows.count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
