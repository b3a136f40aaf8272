"""Every core query with SQL against DuckDB on the smallest tables; the others give rows of a stable schema."""

import glob
import math
import os

import duckdb
import pytest

from leafmill import plans

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(x):
    if hasattr(x, "asDict"):
        return tuple(plain(v) for v in x)
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x if x is None or isinstance(x, (int, bool, str)) else str(x)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = plans.queries()[name](spark, DATA)
    got = canonical(df.columns, df.collect())
    r = duck.execute(plans.oracle_sql()[name])
    columns = [c[0] for c in r.description]
    want = canonical(columns, r.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert [tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in x) for x in got] == [tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in x) for x in want]


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_gives_rows(spark, name):
    assert plans.queries()[name](spark, DATA).count() > 0
