import pytest

import __spark_entry__ as entry
from tests.oracle import connect, rows_of_spark, rows_of_sql

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(name, spark, data, duck):
    names, rows = rows_of_spark(entry.queries()[name](spark, data))
    assert (names, rows) == rows_of_sql(duck, SQL[name])


def test_sql_has_queries():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
