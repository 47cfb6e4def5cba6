"""Every query with SQL is compared with it on the small test tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def _rows(df):
    cols = sorted(df.columns)
    out = []
    for r in df[cols].itertuples(index=False):
        row = []
        for x in r:
            if x is None or x is not x or (isinstance(x, float) and math.isnan(x)) or str(x) in ("<NA>", "NaT", "nan"):
                row.append(None)
            elif isinstance(x, float):
                row.append(round(x, 8) + 0.0)
            else:
                row.append(str(x))
        out.append(tuple(map(repr, row)))
    return cols, sorted(out)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, duck, name):
    got = _rows(entry.queries()[name](spark, DATA).toPandas())
    want = _rows(duck.execute(entry.oracle_sql()[name]).df())
    assert got == want


def test_entry_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
