"""Every query with an oracle: Spark result == DuckDB result on sf0.001 (rows, columns, values)."""

import pytest

import __spark_entry__ as E
from oracle_check import compare

from conftest import SMALL

ORACLE = E.oracle_sql()
NAMES = sorted(ORACLE)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_duckdb(spark, duck, name):
    got = E.queries()[name](spark, SMALL).toPandas()
    want = duck.execute(ORACLE[name]).df()
    ok, msg = compare(name, got, want)
    assert ok, msg


def test_entry_runs(spark):
    out = E.entry(spark)
    assert out.count() >= 0 and "column" in out.columns
