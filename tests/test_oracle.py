"""Every query with a SQL twin returns what the SQL returns; the others return rows."""

import pytest
from oracle import compare, connect

SF = "/root/testdata/sf0.001"


def names():
    from __spark_entry__ import queries

    return list(queries())


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", names())
def test_query(spark, con, name):
    from __spark_entry__ import oracle_sql, queries

    assert compare(spark, con, SF, queries()[name], oracle_sql().get(name)) is None


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() > 0
