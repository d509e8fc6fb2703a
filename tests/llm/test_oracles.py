"""Every query with SQL gives what the SQL gives."""

from __future__ import annotations

import pytest

import corpus_pipeline
from checks import compare
from tests.conftest import SMALL


@pytest.mark.parametrize("name", list(corpus_pipeline.ORACLES))
def test_query_matches_sql(spark, name, monkeypatch):
    monkeypatch.setattr(compare, "QUERIES", corpus_pipeline.QUERIES)
    monkeypatch.setattr(compare, "ORACLES", corpus_pipeline.ORACLES)
    assert compare.differences(spark, compare.tables(SMALL), name, SMALL) is None
