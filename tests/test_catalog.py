"""Every query of the catalog against the same SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from pairloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def rows(cols, data):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return str(round(float(v), 9)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    order = sorted(cols)
    return sorted(tuple(one(r[cols.index(c)]) for c in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf)
    want = duck.execute(catalog.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_rows_only(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(catalog.SQL) <= set(e.oracle_sql()) and set(catalog.QUERIES) <= set(e.queries())
