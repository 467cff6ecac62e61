"""Every query with a SQL twin gives the same rows as DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import lodestone.catalog as catalog
from tests.conftest import SMALL

PAIRED = sorted(catalog.oracle_sql())
ALONE = sorted(set(catalog.queries()) - set(PAIRED))


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in values)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    return con


@pytest.mark.parametrize("name", PAIRED)
def test_same_as_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SMALL)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    ref = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in ref.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(names, ref.fetchall())


@pytest.mark.parametrize("name", ALONE)
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
