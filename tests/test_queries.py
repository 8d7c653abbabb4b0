"""Every registered query with SQL gives the same rows in DuckDB; the others run."""

import pytest
from compare import duck, rows

from mnemolake.plans import all_queries

PLANS, SQL = all_queries()


@pytest.fixture(scope="module")
def db(tiny):
    return duck(tiny)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, tiny, db, name):
    df = PLANS[name](spark, tiny)
    want = db.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(PLANS) - set(SQL)))
def test_runs(spark, tiny, name):
    df = PLANS[name](spark, tiny)
    assert df.count() >= 0 and df.columns


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
