"""Every registered query against its SQL twin, and the entry point."""

import duckdb
import pytest

import __spark_entry__ as driver
from gridloom.plans import PLANS

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", PLANS)
def test_query_agrees_with_sql(spark, duck, name):
    df = driver.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = duck.execute(driver.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
    assert got == want


def test_every_query_has_sql():
    assert set(PLANS) <= set(driver.queries()) and set(PLANS) <= set(driver.oracle_sql())


def test_entry(spark):
    rows = driver.entry(spark).collect()
    assert [r._position for r in rows] == list(range(100))
    prices = [r.o_totalprice for r in rows]
    assert prices == sorted(prices, reverse=True) and min(prices) > 100000
    assert all("HIGH" in r.o_orderpriority for r in rows)
