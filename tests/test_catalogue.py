"""Every query against its SQL; those without SQL at least run and give rows."""

import pytest

from strandline.plans.catalogue import ORACLES, QUERIES

from .oracle import SF, connection, same


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, con, name):
    same(QUERIES[name](spark, SF), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    got = entry.entry(spark)
    assert got.count() == 500 and [r["position"] for r in got.orderBy("position").collect()] == list(range(1, 501))
