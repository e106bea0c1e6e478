"""The queries of the llm subpackage on empty tables and null cells."""

from __future__ import annotations

import pytest

from logfathom.llm import queries
from tests.test_empty import empty, nulls  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):  # noqa: F811
    assert not queries.QUERIES[name](spark, empty).collect()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_null_cells(spark, nulls, name):  # noqa: F811
    queries.QUERIES[name](spark, nulls).collect()
