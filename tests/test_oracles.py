"""Every query with SQL against that SQL."""

import pytest

from sparkloom.plans import catalogue
from tests.compare import connect, duck_rows, spark_rows

SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, con, name):
    columns, found = spark_rows(catalogue.queries()[name](spark, sf))
    expected_columns, expected = duck_rows(con, SQL[name])
    assert columns == expected_columns
    assert len(found) == len(expected)
    assert found == expected


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_query_has_rows(spark, sf, name):
    assert catalogue.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
