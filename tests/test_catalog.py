"""The contract: every query runs on the smallest tables, and agrees with its SQL where it has one."""

import pytest

import __spark_entry__ as entry
from tests import oracle

NAMES = sorted(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, name):
    query, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql:
        assert oracle.compare(spark, oracle.duck(sf), name, query, sql, sf) == ""
    else:
        query(spark, sf).count()
