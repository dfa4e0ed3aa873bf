"""Registered corpus queries against DuckDB where SQL says them."""

from __future__ import annotations

import pytest

from barcraft.llm.queries import ORACLES, QUERIES
from tests.conftest import rows_of, rows_of_sql


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(duck.sql(ORACLES[name]).columns)
    assert rows_of(df) == rows_of_sql(duck, ORACLES[name])


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
