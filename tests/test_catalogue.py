"""Every registered query against its SQL."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from rippleline.plans import asked, catalogue, extraction  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) and not math.isnan(v) else list(v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_sql(spark, sf, con, name):
    want = con.sql(catalogue.ORACLE_SQL[name])
    got = catalogue.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    rows = [tuple(map(plain, r)) for r in got.select(*want.columns).collect()]
    assert sorted(map(str, rows)) == sorted(str(tuple(map(plain, r))) for r in want.fetchall())


def test_entry_and_registration(spark, sf):
    assert entry.entry(spark).columns == ["node", "depth"]
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert catalogue.QUERIES["reach_via_top200"](spark, sf).count() <= 200
