"""Every registered query against its SQL in DuckDB; those without SQL must give rows."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.check import compare, connect

RUNS, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(RUNS))
def test_query(spark, data, con, name):
    got = RUNS[name](spark, data).toPandas()
    if name in SQL:
        assert compare(got, con.execute(SQL[name]).df()) == ""
    else:
        assert len(got) > 0


def test_entry(spark, data):
    assert entry(spark).count() > 0


def test_every_check_belongs_to_a_query():
    assert set(SQL) <= set(RUNS)
