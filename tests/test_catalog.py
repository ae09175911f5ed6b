"""Every registered query against its SQL counterpart on the smallest shared tables."""

import os

import pytest

import __spark_entry__ as entry
from catalog import registry
from catalog.check import compare, connect

SF = "/root/testdata/sf0.001"
# Queries that this copy may lack are tested beside their operators.
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="shared tables are not here")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_counterparts_name_registered_queries():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_counterpart(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name in ORACLE:
        got = duck.execute(ORACLE[name])
        assert compare(df.columns, rows, [d[0] for d in got.description], got.fetchall()) == ""


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "pairs" in df.columns


def test_parts_that_are_not_here_are_left_out():
    assert entry._optional("wavecohort.no_such_part.queries") == {"queries": {}, "oracle": {}}
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
