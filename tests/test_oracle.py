"""Registered queries vs their DuckDB oracles at sf0.001 (the driver checks sf0.01)."""

import pytest

import __spark_entry__ as ENTRY
from tests.conftest import SF_SMALL
from tests.oracle import compare, duck

# the quick SQL-checked queries; the full list runs with `python -m tests.oracle`
FAST = [n for n in ENTRY.oracle_sql() if n.split("_")[0][0] in "adfjopstuw" and not n.startswith(("m", "r", "a34", "p13", "j07"))]


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, ENTRY.queries()[name], ENTRY.oracle_sql()[name], SF_SMALL)
    assert r["ok"], r.get("problems")


def test_entry_smoke(spark):
    df = ENTRY.entry(spark)
    assert df.count() >= 0 and "macro_f1" in df.columns


def test_every_oracle_has_a_query():
    assert set(ENTRY.oracle_sql()) <= set(ENTRY.queries())
