"""Every registered query with SQL gives DuckDB's rows; the others give rows."""

import pytest

from sparrel.plans import registry
from tests.compare import connect, duck_rows, spark_rows


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, con, name):
    got = spark_rows(registry.queries()[name](spark, sf_dir))
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got[1]
    else:
        assert got == duck_rows(con, sql)
