"""Every query against its SQL on the smallest tables; queries without SQL must run and have rows."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

NAMES = sorted(k for k in entry.queries() if k.startswith("q") or k in ("p2_found", "p4_found", "p5_found"))


def plain(v):
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 0):
        return tuple(plain(x) for x in v)
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
        return None
    v = v.item() if hasattr(v, "item") else v
    return round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def bag(df: pd.DataFrame) -> Counter:
    return Counter(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, data, name):
    got = entry.queries()[name](spark, data).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = duck.execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert bag(got) == bag(want)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
