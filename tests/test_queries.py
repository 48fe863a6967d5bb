"""Every registered query against its SQL."""

import pytest
from oracle import compare, duck

import __spark_entry__ as entry_module

QUERIES = entry_module.queries()
ORACLES = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    pytest.importorskip("duckdb")
    return duck(sf)


def test_every_query_has_sql():
    optional = set(entry_module.LLM_QUERIES)  # tested against brute force in their own folder
    assert set(QUERIES) - optional == set(ORACLES) - optional
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, con, name):
    assert compare(spark, con, sf, QUERIES[name], ORACLES[name]) is None


def test_entry(spark, sf):
    row = entry_module.entry(spark).collect()
    assert len(row) == 1 and row[0]["n"] > 0
