"""Every registered query against its SQL."""

import pytest

from __spark_entry__ import entry
from catalog.oracle import oracle_sql
from catalog.queries import queries
from tools.check import compare, connect

SF = "/root/testdata/sf0.001"
KNOWN, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(KNOWN) == set(SQL)


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(KNOWN))
def test_query(spark, con, name):
    line = compare(spark, con, SF, name, KNOWN[name], SQL[name])
    assert line.startswith("ok"), line
