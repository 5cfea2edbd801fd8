"""Every catalogue query against its SQL twin on the smallest data."""

import pytest

from tests.oracle_check import compare, connect
from tracewell.plans.catalog import QUERIES
from tracewell.plans.oracles import ORACLES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_only_the_similarity_query_has_no_sql():
    assert set(QUERIES) - set(ORACLES) == {"ground_truth"}
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert compare(QUERIES[name](spark, SMALL), duck, ORACLES[name]) == []


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 75
    assert entry.queries().keys() >= QUERIES.keys() and entry.oracle_sql().keys() >= ORACLES.keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()
