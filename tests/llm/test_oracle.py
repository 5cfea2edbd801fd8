"""Corpus queries that SQL can express, against that SQL on the smallest data."""

import pytest

from tests.oracle_check import compare, connect
from tracewell.llm.queries import LLM_ORACLES, LLM_QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(LLM_ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert compare(LLM_QUERIES[name](spark, SMALL), duck, LLM_ORACLES[name]) == []


def test_all_operators_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names
