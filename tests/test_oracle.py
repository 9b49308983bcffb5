"""Every query against its DuckDB statement on the smallest tables; the rest must at least yield rows."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    state, n, _, _, info = compare(spark, duck, name, queries()[name], oracle_sql().get(name), FOLDER)
    assert state in ("ok", "rows"), info
    assert n > 0


def test_entry(spark):
    assert entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())
