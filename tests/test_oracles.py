"""Every registered query against its SQL (or, without SQL, for rows) on the smallest tables."""

import pytest

import __spark_entry__ as entry_module
from tests.oracle_check import compare, duck

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry_module.queries()))
def test_query(spark, con, name):
    assert compare(spark, con, SF_DIR, entry_module.queries()[name], entry_module.oracle_sql().get(name)) is None


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
