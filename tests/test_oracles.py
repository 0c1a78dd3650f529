"""Every query that has SQL, against that SQL on the smallest driver tables (skipped where they are not there)."""

import datetime
import decimal
import math
import os

import pytest

from graphmill import plans

DATA = os.environ.get("GRAPHMILL_TESTDATA", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in os.listdir(DATA):
        path = f"{DATA}/{name}" + ("/*.parquet" if os.path.isdir(f"{DATA}/{name}") else "")
        con.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return repr(v)
    if isinstance(v, int | float | decimal.Decimal):
        f = float(v)
        return "nan" if math.isnan(f) else f"{f:.6g}"
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, datetime.date) and not isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def test_every_sql_has_its_query():
    assert set(plans.oracle_sql()) <= set(plans.queries())


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_same_rows(spark, sql, name):
    df = plans.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    cursor = sql.execute(plans.oracle_sql()[name])
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == columns
    want = sorted(tuple(plain(row[theirs.index(c)]) for c in columns) for row in cursor.fetchall())
    assert sorted(tuple(plain(row[c]) for c in columns) for row in df.collect()) == want
