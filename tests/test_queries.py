import pytest

import __spark_entry__ as entry
from compare import connect, duck_rows, spark_rows
from sparkmart.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert QUERIES.items() <= entry.queries().items() and ORACLES.items() <= entry.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, con, sf_dir, name):
    got = spark_rows(entry.queries()[name](spark, sf_dir))
    assert got == duck_rows(con, ORACLES[name])
