"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, duck

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_sql(spark, con, name):
    ok, message = compare(spark, con, name, queries()[name], oracle_sql().get(name), SF_DIR)
    assert ok, message


def test_every_check_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_has_rows(spark):
    out = entry(spark)
    assert out.columns == ["job_id", "worker", "items", "inputs", "max_seed", "refused"]
    assert out.count() > 0
