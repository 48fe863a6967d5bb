"""Registered queries: SQL where there is any, one query for each operator, and names that fit."""

import re

import pytest
from oracle import compare, duck

import __spark_entry__ as entry_module
import corpus_pipeline
from verdigris.llm.queries import ORACLES, QUERIES


def test_each_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 14))
    assert {"pipeline", *QUERIES} <= set(entry_module.queries())
    assert entry_module.queries()["pipeline"] is corpus_pipeline.run
    assert set(ORACLES) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, name):
    assert compare(spark, duck(sf), sf, QUERIES[name], ORACLES[name]) is None
