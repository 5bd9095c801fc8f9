"""Every registered query runs on the smallest tables and equals its SQL twin."""

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry
from verify_oracles import bag

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CORE = [n for n in entry.queries() if not entry.queries()[n].__module__.startswith("graphloom.llm")]
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = bag(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql:
        cur = duck.execute(sql)
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert got == bag(names, cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
