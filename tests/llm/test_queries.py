"""The training-data queries that SQL can express, against their oracles."""

from __future__ import annotations

import pytest

from tests.compare import SF_DIR, assert_same
from tidemark.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_oracle(spark, name):
    assert assert_same(QUERIES[name](spark, SF_DIR), ORACLES[name]) > 0
