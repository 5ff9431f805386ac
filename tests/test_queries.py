"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

import glob
import math
from pathlib import Path

import pytest

import __spark_entry__ as entry
from gridquill.plans import queries as core

duckdb = pytest.importorskip("duckdb")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        c.execute(f"create view {Path(f).stem} as from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_against_sql(spark, small, duck, name):
    df = core.queries()[name](spark, small)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    cursor = duck.execute(core.oracle_sql()[name])
    at = [d[0] for d in cursor.description]
    assert sorted(at) == columns
    want = sorted((tuple(plain(r[at.index(c)]) for c in columns) for r in cursor.fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_runs(spark, small, name):
    assert core.queries()[name](spark, small).count() > 0 or name in ("p1_children", "p1_rejects")  # the smallest records have none


def test_entry(spark):
    assert entry.entry(spark).count() == 6
