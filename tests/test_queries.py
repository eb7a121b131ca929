"""Every registered query of the research engine against its SQL, and a stable schema for the others."""

from __future__ import annotations

import pytest

from tests.conftest import DATA
from tests.util import assert_same
from tidemark.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in SQL:
        assert_same(got, oracle(SQL[name]))
    else:
        assert len(got.columns) and len(got)


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 2
