"""Every named query against its SQL."""

import pytest

import __spark_entry__ as entry_module
from compare import differences, duck
from recordflow.plans import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(spark, sf_dir, con, name):
    found = differences(registry.QUERIES[name](spark, sf_dir), con, registry.ORACLE[name])
    assert found is None, found


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_driver_contract(spark):
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert entry_module.entry(spark).columns[0] == "user_id"
