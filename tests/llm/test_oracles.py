"""Queries with SQL: the same rows from DuckDB; and the contract's columns."""

import pytest

from telemark.llm.queries import ORACLES, QUERIES
from tests.conftest import SF01
from tests.oracle_check import compare, duck


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], ORACLES[name], SF01)
    assert r.get("ok") is True, r


def test_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
