"""Every registered query against its SQL oracle on the smallest tables; the others must give rows."""

import pytest
from oracle_check import compare, duck

import __spark_entry__ as entry
from inkspan.plans import registry

FOLDER = "/root/testdata/sf0.001"
# The training-text operators have their own tests.
QUERIES, ORACLES = registry.QUERIES, registry.ORACLE


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("key", list(QUERIES))
def test_query(spark, con, key):
    df = QUERIES[key](spark, FOLDER)
    if key in ORACLES:
        assert compare(df, ORACLES[key], con) is None
    else:
        assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
