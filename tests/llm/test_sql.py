"""The registered corpus queries against their DuckDB SQL on whole small tables."""

from __future__ import annotations

import os

import pytest

from linkwatch.llm import catalog
from tools.oracle_check import _rows, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", catalog.oracle_sql())
def test_equals_sql(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    df = catalog.queries()[name](spark, SF)
    rel = duck(SF).sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    got, want = _rows(df.columns, [tuple(r) for r in df.collect()]), _rows(rel.columns, rel.fetchall())
    assert got == want
