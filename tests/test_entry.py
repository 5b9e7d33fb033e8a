from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from quillspan.plans import catalog

DATA = "/root/testdata/sf0.001"
EMPTY_HERE = {"roles", "schema_index"}  # what no row of the smallest tables meets


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", catalog.oracle_sql())
def test_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    want = duck.execute(f"select {', '.join(f'"{c}"' for c in cols)} from ({entry.oracle_sql()[name]})").fetchall()
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    assert got == sorted(repr([plain(x) for x in r]) for r in want)
    assert got or name in EMPTY_HERE


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
