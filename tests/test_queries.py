"""Every named query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import difference, oracle_rows, spark_rows
from webtables.plans import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    found = spark_rows(queries()[name](spark, FOLDER))
    assert difference(found, oracle_rows(FOLDER, oracle_sql()[name])) is None


def test_every_query_of_the_plans_has_sql():
    assert set(QUERIES) == set(ORACLES) and set(QUERIES) <= set(queries())


def test_entry_has_rows(spark):
    assert entry(spark).count() == 100
