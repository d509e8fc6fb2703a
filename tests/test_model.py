"""Training, persistence, scoring."""

from __future__ import annotations

from datetime import datetime
from uuid import uuid4

import pytest
from pyspark.sql import functions as F

from checks import registry
from kerbstat.operators.features import load_features, training_frame
from kerbstat.plans.model import ClassModel, fit_model, predictions
from kerbstat.plans.scoring import REQUEST_DEFAULTS, score
from kerbstat.plans.training import evaluation_frame, run_evaluation, run_training
from kerbstat.schema import COLUMN_ROLES
from kerbstat.session import work_dir
from tests.conftest import SMALL

SMALL_FOREST = {"numTrees": 5, "maxDepth": 5}


@pytest.fixture(scope="module")
def root(spark):
    return f"{work_dir(spark)}/models-{uuid4().hex}"


@pytest.fixture(scope="module")
def run(citations, root):
    return run_training(citations, params=SMALL_FOREST, output=root)


def test_training(run, citations):
    sizes = {r["split"]: r["rows"] for r in run.split_sizes.collect()}
    total = sum(sizes.values())
    assert sizes["test"] == pytest.approx(total * 0.2, abs=10)
    assert sizes["validation"] == pytest.approx(total * 0.08, abs=10)
    assert total + run.removed.first()["removed_rows"] == citations.dropna(subset=["issue_date", "violation_code"]).count()
    held = run.held_out.cache()
    assert held.count() == sizes["test"] + sizes["validation"]
    sums = held.select(F.aggregate("probability", F.lit(0.0), lambda a, p: a + p).alias("s"))
    assert sums.where(F.abs(F.col("s") - 1) > 1e-9).count() == 0
    majority = held.groupBy("label").count().agg(F.max("count")).first()[0] / held.count()
    assert min(r["accuracy"] for r in run.scores.collect()) > majority


def test_every_feature_column_has_a_role(citations):
    roles = [c for role in ("numeric", "categorical", "id_columns", "drop_columns") for c in COLUMN_ROLES[role]]
    assert len(roles) == len(set(roles))
    assert set(load_features(citations).columns) - set(roles) == {"violation_code"}
    with pytest.raises(ValueError, match="no target"):
        run_training(citations, target="hour")


def test_features_and_importance(run):
    assert run.model.features == [*COLUMN_ROLES["numeric"], *COLUMN_ROLES["categorical"]]
    shares = [r["importance"] for r in run.model.importance().collect()]
    assert len(shares) == 18 and shares == sorted(shares, reverse=True) and sum(shares) == pytest.approx(1)
    info = run.model.info(10).first()
    assert info["target"] == "violation_code" and info["num_classes"] == len(run.model.labels)
    assert len(info["top_features"]) == 10 and info["top_features"][0]["importance"] == shares[0]


def test_save_load_latest(spark, run, root):
    older = run.model.save(root, "20000101_000000")
    assert older != run.path
    back = ClassModel.load_latest(spark, root)
    assert (back.labels, back.features, back.target) == (run.model.labels, run.model.features, run.model.target)
    assert back.importance().collect() == run.model.importance().collect()


def test_a_version_is_written_once(run, root):
    assert run.model.save(root) != run.model.save(root)
    run.model.save(root, "20000102_000000")
    with pytest.raises(Exception, match="(?i)exist"):
        run.model.save(root, "20000102_000000")


def test_training_and_evaluation_samples_are_independent(citations):
    train = load_features(citations, sample=0.3).select("summons_number")
    evaluated = evaluation_frame(citations, sample=0.3).select("summons_number")
    n, both = evaluated.count(), evaluated.join(train, "summons_number", "left_semi").count()
    assert both / n == pytest.approx(0.3, abs=0.06)


def test_report_of_held_out_rows(run):
    lines = {(r["section"], r["name"]): r["value"] for r in run.report().collect()}
    sizes = {r["split"]: r["rows"] for r in run.split_sizes.collect()}
    support = sum(v for (s, n), v in lines.items() if n == "support")
    assert support == sizes["test"] + sizes["validation"]
    assert {s for s, _ in lines if s.startswith("class ")} == {f"class {name}" for name in run.model.labels}


def test_fit_does_not_depend_on_how_the_input_is_split(citations):
    frame = training_frame(load_features(citations))
    models = [fit_model(f, params=SMALL_FOREST) for f in (frame.coalesce(1), frame.repartition(7), frame.orderBy("county" if "county" in frame.columns else "hour"))]
    answers = [sorted((r["summons_number"], r["prediction"]) for r in predictions(m, frame).collect()) for m in models]
    assert answers[0] == answers[1] == answers[2]


def test_evaluation(run, citations):
    lines, unseen = run_evaluation(citations, run.model, sample=0.5)
    values = {(r["section"], r["name"]): r["value"] for r in lines.collect()}
    assert 0 < values["overall", "accuracy"] <= values["overall", "top_3_accuracy"] <= 1
    assert unseen.count() == 0


def test_unseen_classes_are_reported(run, citations):
    renamed = citations.withColumn(
        "violation_code", F.when(F.col("violation_code") == "3", "new").otherwise(F.col("violation_code"))
    )
    _, unseen = run_evaluation(renamed, run.model, sample=None)
    assert [r["violation_code"] for r in unseen.collect()] == ["new"]


def test_boosted_learner_keeps_the_contract(spark, citations):
    frame = training_frame(load_features(citations.where("violation_code IN ('0', '1', '2')")))
    model = fit_model(frame, learner="boosted", params={"rounds": 2, "depth": 3}, exclude=("is_broadway",))
    assert "is_broadway" not in model.features
    out = predictions(model, frame).limit(50).collect()
    for r in out:
        assert sum(r["probability"]) == pytest.approx(1)
        assert r["probability"][r["prediction"]] == max(r["probability"])


def test_other_target(citations):
    frame = training_frame(load_features(citations), "borough")
    model = fit_model(frame, "borough", params={"numTrees": 2, "maxDepth": 3})
    assert "borough" not in model.features and set(model.labels) <= {
        "Manhattan", "Brooklyn", "Queens", "Bronx", "Staten Island", "Unknown"
    }


def test_score(spark, run):
    requests = spark.createDataFrame(
        [("a", 40.7580, -73.9855, datetime(2024, 1, 15, 14, 30), "19"), ("b", None, None, None, None)],
        "request_id string, latitude double, longitude double, datetime timestamp, precinct string",
    )
    out = {r["request_id"]: r for r in score(requests, run.model).collect()}
    for r in out.values():
        top = r["top_predictions"]
        assert len(top) == 5 and r["predicted_violation"] in run.model.labels
        assert r["confidence"] == top[0]["probability"] >= top[1]["probability"]
    assert out["a"]["input"]["precinct"] == "19" and out["a"]["input"]["county"] == REQUEST_DEFAULTS["county"]
    assert out["b"]["input"]["precinct"] == "UNKNOWN" and out["b"]["input"]["datetime"] is not None


def test_unreadable_requests_keep_their_rows(spark, run):
    requests = spark.createDataFrame(
        [("a", "2024-01-15 14:30:00", "40.7"), ("b", "soon", "40.7"), ("c", None, "north"), ("d", None, None)],
        "request_id string, datetime string, latitude string",
    )
    now = datetime(2024, 1, 15, 9, 0)
    out = {r["request_id"]: r for r in score(requests, run.model, now=now).collect()}
    assert len(out) == 4
    assert out["a"]["error"] is None and out["a"]["predicted_violation"] in run.model.labels
    assert out["b"]["error"] == "unreadable datetime" and out["b"]["predicted_violation"] is None
    assert out["c"]["error"] == "unreadable latitude" and out["c"]["top_predictions"] is None
    assert out["d"]["input"]["datetime"] == now and out["d"]["error"] is None


def test_request_hour_is_that_of_its_time(spark):
    from kerbstat.plans.scoring import complete, request_features

    requests = spark.createDataFrame([(datetime(2024, 1, 15, 14, 30),), (datetime(2024, 1, 13, 0, 5),)], "datetime timestamp")
    rows = request_features(complete(requests)).select("hour", "time_of_day", "is_weekend").collect()
    assert [tuple(r) for r in rows] == [(14, "afternoon", 0), (0, "night", 1)]


def test_each_query_fits_anew(spark):
    seen = []
    query = registry.over_fits(lambda fits: seen.append(fits) or spark.range(1))
    assert query(spark, SMALL).count() == query(spark, SMALL).count() == 1
    assert seen[0] is not seen[1] and seen[0].root != seen[1].root
