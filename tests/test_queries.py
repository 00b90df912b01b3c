"""Every registered query against its SQL on DuckDB, at the smallest scale."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tracewell.plans import registry
from verify import TABLES, rows

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.QUERIES, registry.ORACLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).columns


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)
    found = duck.execute(ORACLES[name])
    want = pd.DataFrame(found.fetchall(), columns=[d[0] for d in found.description], dtype=object)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
