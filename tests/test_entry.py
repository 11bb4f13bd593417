import os

import duckdb
import pytest

import __spark_entry__ as entry
from loam import catalog

DIR = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


@needs_data
def test_flagship(spark):
    assert entry.entry(spark).count() == 3


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.oracle_sql()) == set(catalog.queries())


def _plain(v):
    return v.isoformat() if hasattr(v, "isoformat") else v


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    found = con.sql(catalog.oracle_sql()[name])
    df = catalog.queries()[name](spark, DIR)
    assert sorted(df.columns) == sorted(found.columns)
    order = [found.columns.index(c) for c in df.columns]
    wanted = sorted(repr([_plain(r[i]) for i in order]) for r in found.fetchall())
    assert sorted(repr([_plain(v) for v in r]) for r in df.collect()) == wanted
