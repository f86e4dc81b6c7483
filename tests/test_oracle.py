"""Every query with a SQL twin gives the twin's rows."""

import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "orders", "lineitem")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in rows)


def own(names):
    """Without the queries of the subpackage that has tests of its own."""
    return sorted(set(names) - set(entry.training.QUERIES if entry.training else ()) - {"pipeline"})


@pytest.mark.parametrize("name", own(entry.oracle_sql()))
def test_query(spark, duck, name):
    frame = entry.queries()[name](spark, FOLDER)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(frame.columns) == sorted(columns)
    ours = canonical([tuple(r) for r in frame.collect()], frame.columns)
    theirs = canonical(result.fetchall(), columns)
    assert ours and ours == theirs


def test_queries_without_twin(spark):
    assert set(own(entry.queries())) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() == 5 * 7 * 7
