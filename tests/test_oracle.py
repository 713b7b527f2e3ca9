"""Every registered query on the smallest data, against its SQL where it has one."""

import pytest

import __spark_entry__ as entry
from tools.check_oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, key):
    got = QUERIES[key](spark, SF).toPandas()
    if key in ORACLE:
        assert compare(got, con.execute(ORACLE[key]).fetchdf()) == ""
    else:
        assert len(got) > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(ORACLE) <= set(QUERIES)
