"""Every query of the catalogue against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from sheetwise.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def tidy(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.ORACLES])
def test_twin(spark, con, name):
    got = catalog.QUERIES[name](spark, SF)
    want = con.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    rows = lambda rs, cols: sorted((tuple(tidy(r[cols.index(c)]) for c in order) for r in rs), key=str)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)


def test_files(spark):
    assert catalog.QUERIES["s1_scan_files"](spark, SF).count() == len(TABLES)
    assert {r["format"] for r in catalog.QUERIES["s2_sniff_format"](spark, SF).collect()} == {"PARQUET"}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
