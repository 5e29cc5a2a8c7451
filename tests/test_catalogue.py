"""Every registry query against its SQL in DuckDB."""

import datetime
import glob
import os

import duckdb
import pytest

from ledgerlink.plans import registry

DATA = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


def shown(x):
    if isinstance(x, datetime.datetime):
        return str(x.replace(tzinfo=None))
    return repr(round(x, 6)) if isinstance(x, float) else str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    got = [r.asDict() for r in df.collect()]
    cursor = duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = [dict(zip(columns, r)) for r in cursor.fetchall()]
    line = lambda r: tuple(shown(r[c]) for c in sorted(columns))
    assert sorted(map(line, got)) == sorted(map(line, want))


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0
