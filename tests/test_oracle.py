"""Every core query with SQL gives the same rows in Spark and DuckDB."""

import decimal
import glob
import os

import duckdb
import pytest

from folioflow.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5) + 0.0
    return float(v) if isinstance(v, decimal.Decimal) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cur = duck.execute(registry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    mine = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=str)
    theirs = sorted((tuple(plain(r[cols.index(c)]) for c in order) for r in cur.fetchall()), key=str)
    assert mine == theirs


def test_every_line_is_packed(spark):
    got = {r.line_id for r in registry.queries()["packed_windows"](spark, SF).select("line_id").distinct().collect()}
    assert got == {r.line_id for r in registry.lines_of(spark, SF).where("text is not null").select("line_id").collect()}


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
