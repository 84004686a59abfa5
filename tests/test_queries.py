import pytest

from tests.checking import SF, same
from turnmill import registry

SQL = registry.oracle_sql()
ROWS_ONLY = sorted(registry.queries().keys() - SQL.keys())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    same(spark, registry.queries()[name], SQL[name])


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, SF).columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
