"""Every registered query at the smallest scale, against its SQL where it has one."""

import pytest
from oracle import check, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    _, rows, problem = check(spark, con, name, QUERIES[name], SQL.get(name), SF)
    assert problem is None, problem


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "model"


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
