"""Every registered job-ad query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from adweave.plans import registry

DATA = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()

pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="the given tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def ordered(columns, rows):
    at = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    found = duck.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    got, want = ordered(df.columns, [tuple(r) for r in df.collect()]), ordered(columns, found.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    df = registry.queries()[name](spark, DATA)
    rows = df.collect()
    assert df.columns and len(rows) > 0 and len(rows) == len(set(map(str, rows)))  # none of them repeats a row
