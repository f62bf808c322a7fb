"""Every query of the engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from quillon import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{SF}/{name}')")
    return c


def compare(spark, sql, name, query, text):
    got = query(spark, SF)
    columns = sorted(got.columns)
    cursor = sql.execute(text)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    norm = lambda x: round(x, 9) if isinstance(x, float) else x
    want = sorted((tuple(norm(r[i]) for i in order) for r in cursor.fetchall()), key=repr)
    have = sorted((tuple(norm(r[c]) for c in columns) for r in got.collect()), key=repr)
    assert have == want


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sql, name):
    compare(spark, sql, name, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
