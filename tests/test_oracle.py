"""Every registered query with an oracle equals DuckDB on the sf0.001 tables."""

from __future__ import annotations

import pytest

from conftest import SF_SMALL
from linkwatch.plans.catalog import oracle_sql, queries

import os
import sys

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from oracle_check import _rows, duck  # noqa: E402

SQL = oracle_sql()
SPARK_TO_DUCK = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
    "date": "DATE",
}
QUERIES = queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs_and_matches(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    assert name in SQL
    rel = con.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    duck_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    for col, spark_type in df.dtypes:
        assert SPARK_TO_DUCK.get(spark_type, spark_type) == duck_types[col], (col, spark_type, duck_types[col])
    assert _rows(df.columns, rows) == _rows(rel.columns, rel.fetchall())
