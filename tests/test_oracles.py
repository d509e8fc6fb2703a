"""Every registered query with SQL gives what the SQL gives; plans hold nothing quadratic."""

from __future__ import annotations

import pytest

from checks.compare import differences, tables
from checks.oracles import ORACLES
from checks.registry import QUERIES
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def db():
    return tables(SMALL)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_sql(spark, db, name):
    assert differences(spark, db, name, SMALL) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize(
    "name",
    ["violation_summary", "location_risk_scores", "agency_stats", "fine_distribution", "stratified_split",
     "encoded_features", "confusion_topn", "metric_report"],
)
def test_plan_has_no_cross_product(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
