import pytest

import check_queries
from __spark_entry__ import entry, oracle_sql, queries
from homeward.plans.oracle import ORACLE
from homeward.plans.queries import QUERIES


@pytest.fixture(scope="module")
def connection(sf_dir):
    return check_queries.duck(sf_dir)


def test_every_query_has_checking_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(queries())
    assert set(ORACLE) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, sf_dir, connection, name):
    df = queries()[name](spark, sf_dir)
    cursor = connection.execute(oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    want = check_queries.rows_of(columns, cursor.fetchall())
    got = check_queries.rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got == want


def test_entry(spark):
    assert entry(spark).count() > 0
