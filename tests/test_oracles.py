"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from sparkloom.plans import more, queries as q  # noqa: F401  more adds its queries

DATA = "/root/testdata/sf0.001"
SLOW = {"kmer_profile", "fa_six_frame"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return "" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(set(q.ORACLES) - SLOW))
def test_query_equals_sql(spark, con, name):
    df = q.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    r = con.sql(q.ORACLES[name])
    assert sorted(r.columns) == cols
    want = sorted(tuple(plain(dict(zip(r.columns, x))[c]) for c in cols) for x in r.fetchall())
    got = sorted(tuple(plain(x[c]) for c in cols) for x in df.collect())
    assert got == want
