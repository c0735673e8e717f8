"""Every registered query on the smallest tables, against its SQL equivalent where there is one."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    difference, _, _ = compare(spark, con, name, FOLDER, QUERIES, SQL)
    assert not difference


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert {r.split for r in rows} == {"train", "val", "test"}


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)
