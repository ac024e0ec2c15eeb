"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as registered
from compare import canonical, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = registered.queries()[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    cursor = con.execute(registered.oracle_sql()[name])
    expected = canonical([c[0] for c in cursor.description], cursor.fetchall())
    assert canonical(df.columns, rows) == expected


def test_entry(spark):
    df = registered.entry(spark)
    assert {r["label"] for r in df.collect()} == {"quality", "toxic"}
