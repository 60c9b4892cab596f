"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from compare import check, connect

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, small, name):
    verdict = check(spark, duck, small, QUERIES[name], ORACLES[name])
    assert verdict.startswith("exact"), verdict


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.count() > 0 and "account_id" in rows.columns


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
