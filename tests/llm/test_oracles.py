"""Corpus queries with SQL against DuckDB."""

import pytest

from onoma.llm.queries import ORACLES, QUERIES
from tests.test_catalog import compared


@pytest.mark.parametrize("name", list(ORACLES))
def test_oracle(spark, name):
    got, expected = compared(spark, QUERIES[name], ORACLES[name])
    assert got == expected
