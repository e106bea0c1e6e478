"""Every query on empty tables and on tables whose every cell but the first column is null."""

from __future__ import annotations

import glob
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from logfathom.plans import catalog


def variant(data: str, out: str, nulls: bool) -> str:
    for p in glob.glob(f"{data}/*.parquet"):
        t = pq.read_table(p)
        if nulls:
            t = t.slice(0, 5)
            t = pa.table([t.column(0), *(pa.nulls(len(t), f.type) for f in list(t.schema)[1:])] if t.num_columns else [], names=t.column_names)
        else:
            t = t.slice(0, 0)
        pq.write_table(t, f"{out}/{os.path.basename(p)}")
    return out


@pytest.fixture(scope="module")
def empty(data, tmp_path_factory):
    return variant(data, str(tmp_path_factory.mktemp("empty")), False)


@pytest.fixture(scope="module")
def nulls(data, tmp_path_factory):
    return variant(data, str(tmp_path_factory.mktemp("nulls")), True)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_empty_tables(spark, empty, name):
    rows = entry.queries()[name](spark, empty).collect()
    assert all(not r["n"] for r in rows) if name in ("q02_pattern_totals_zero_filled", "q49_keyword_buckets", "q58_pattern_days") else name == "q46_lint_cross_reference" or not rows


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_null_cells(spark, nulls, name):
    entry.queries()[name](spark, nulls).collect()
