"""Every catalogue query against its SQL, at the smallest scale."""

import pytest

from __spark_entry__ import entry
from check import connect, difference
from keyedflow.plans.catalogue import QUERIES
from keyedflow.plans.oracle import ORACLE


@pytest.fixture(scope="module")
def db(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, db, name):
    assert difference(QUERIES[name](spark, sf_dir), db, ORACLE[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    assert entry(spark).columns == ["key", "n", "total", "window_start", "window_end", "ts_ms"]
