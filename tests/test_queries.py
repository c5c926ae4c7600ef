"""Every query with SQL gives what DuckDB gives on the same tables."""

import glob
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from cohortforge.plans import QUERIES, SQL  # noqa: E402

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, bool):
            return str(int(v))
        if isinstance(v, (int, float)):
            return f"{float(v) + 0.0:.5f}"
        return str(v)

    return [sorted(names)], sorted([[cell(r[i]) for i in order] for r in rows])


def close(a, b):
    if a == b:
        return True
    try:
        return abs(float(a) - float(b)) <= 2e-5 * max(1.0, abs(float(a)))
    except ValueError:
        return False


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


@needs_data
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    want = con.sql(SQL[name])
    heads, ours = canonical(rows, got.columns)
    wanted, theirs = canonical(want.fetchall(), want.columns)
    assert heads == wanted
    assert len(ours) == len(theirs)
    assert all(close(x, y) for a, b in zip(ours, theirs, strict=True) for x, y in zip(a, b, strict=True)), next((a, b) for a, b in zip(ours, theirs, strict=True) if a != b)


@needs_data
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
