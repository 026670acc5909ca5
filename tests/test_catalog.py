"""Every catalog query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_sql(spark, con, name):
    good, message = compare(spark, con, FOLDER, name)
    assert good, message


def test_entry(spark):
    rows = entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"n", "p", "mean", "err_low", "err_high", "n_samples"}


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
