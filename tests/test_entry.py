"""Every registered query against its DuckDB oracle on the smallest tables.

The driver runs the same comparison at sf0.01 (``tests/run_oracle.py``
reproduces it); here sf0.001 keeps the suite quick.
"""

import pytest

import __spark_entry__ as E
from conftest import SF001
from oracle_check import compare, duck

SQL = E.oracle_sql()
ROWS_ONLY = sorted(set(E._QUERIES) - set(SQL))


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


def test_contract_shape():
    assert set(SQL) <= set(E.queries())
    assert ROWS_ONLY == []


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(E.queries()[name](spark, SF001), con, SQL[name])
    assert ok, msg


def test_entry_runs(spark):
    df = E.entry(spark)
    row = df.first()
    assert row.total_items_in_dataset == 200 and row.evaluated_items_count > 0
