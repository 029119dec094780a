"""Every query with SQL gives what DuckDB gives."""

import pytest
from compare import differences, duck
from conftest import SF_SMALL

import __spark_entry__ as entry_module


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_sql_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    got = entry_module.queries()[name](spark, SF_SMALL).toPandas()
    want = con.execute(entry_module.oracle_sql()[name]).df()
    assert not differences(got, want)
    assert len(got)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
