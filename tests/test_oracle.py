"""Every query with SQL against DuckDB; the others run and keep their schema."""

import pytest

from pointloom.plans.catalog import QUERIES, SQL

from .compare import DATA, same, tables

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables are absent")


@pytest.fixture(scope="module")
def con():
    return tables()


@pytest.mark.parametrize("name", sorted(SQL))
def test_like_sql(spark, con, name):
    same(QUERIES[name](spark, str(DATA)).toPandas(), con.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, str(DATA))
    assert len(df.columns) == len(set(df.columns)) and df.count() > 0
