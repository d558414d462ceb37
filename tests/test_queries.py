"""Every registered query of the library against its SQL in DuckDB, and those without SQL for rows."""

import oracle
import pytest

from lodestack.plans import registry


@pytest.fixture(scope="module")
def con(data):
    return oracle.connect(data)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, con, data, name):
    assert oracle.differences(spark, con, data, name, registry.QUERIES[name], registry.ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_gives_rows(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
