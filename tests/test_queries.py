"""Registered queries against SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from rutine.registry import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
#: Queries that run a whole grammar first; one of each kind is enough here.
SLOW = {"q_cores_mad", "q_cores_threshold", "q_density_distribution", "q_density_quantiles", "q_density_variance", "q_app_switch", "q_rule_expand"}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the shared tables are not here")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return float(f"{float(v):.9g}") if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(set(SQL) - SLOW))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    found = duck.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(v) for v in r) for r in found.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).limit(5).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
