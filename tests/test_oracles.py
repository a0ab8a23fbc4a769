"""Every query with an SQL twin gives the same rows as it on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from siftwell.plans.catalogue import ORACLES, QUERIES

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, float):
        return f"{v:.6f}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        at = f"{f}/*.parquet" if os.path.isdir(f) else f
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{at}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_match(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    want = sorted(tuple(map(plain, r)) for r in rel.select(*[f'"{c}"' for c in cols]).fetchall())
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "doc_id", "rank", "score", "tokens", "running"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
