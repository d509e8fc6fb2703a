"""Forests over histograms."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from kerbstat.plans import forest
from kerbstat.plans.boosting import feature_array
from kerbstat.plans.model import ClassModel, fit_model, predictions
from kerbstat.session import stage, work_dir

FEATURES = ["a", "b", "c"]
ONE_TREE = {"numTrees": 1, "maxDepth": 4, "minInstancesPerNode": 3, "subsamplingRate": 1.0, "featureSubsetStrategy": "all", "maxBins": 64}


@pytest.fixture(scope="module")
def rows(spark):
    """Rows of four classes that depend on two of three features; a third of them come twice."""
    a, b, c = (F.pmod(F.xxhash64("id", F.lit(s)), F.lit(n)) for s, n in (("a", 40), ("b", 25), ("c", 10)))
    noise = F.pmod(F.xxhash64("id", F.lit("noise")), F.lit(10)) == 0
    frame = spark.range(3000).select("id", a.cast("double").alias("a"), b.cast("double").alias("b"), c.cast("double").alias("c"), noise.alias("noise"))
    label = F.when(F.col("noise"), F.col("c") % 4).otherwise((F.col("a") > 17).cast("int") * 2 + (F.col("a") + F.col("b") > 30).cast("int"))
    return stage(frame.select("id", *FEATURES, label.cast("int").alias("label")).union(frame.where("id % 3 = 0").select("id", *FEATURES, label.cast("int").alias("label"))), "rows")


def mllib(rows, **params):
    labelled = rows.withColumn("label", F.col("label").cast("double"))
    learner = RandomForestClassifier(labelCol="label", featuresCol="features", seed=1, **params)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), learner]).fit(labelled)


@pytest.mark.parametrize("impurity", ["gini", "entropy"])
def test_one_tree_of_all_rows_and_features_is_that_of_mllib(rows, impurity):
    fitted = mllib(rows, bootstrap=False, impurity=impurity, **ONE_TREE)
    own = forest.fit_forest(rows, FEATURES, 4, forest.Settings(bootstrap=False, impurity=impurity, **ONE_TREE))
    assert own.importance() == pytest.approx(fitted.stages[-1].featureImportances.toArray(), abs=1e-9)
    both = fitted.transform(rows).select(
        vector_to_array("probability").alias("theirs"), forest.probabilities(own)(feature_array(FEATURES)).alias("ours")
    ).distinct().collect()
    assert len(both) > 5
    for r in both:
        assert r["ours"] == pytest.approx(r["theirs"], abs=1e-12)


def test_a_forest_is_about_that_of_mllib(rows):
    params = {**ONE_TREE, "numTrees": 30, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.6"}
    own = forest.fit_forest(rows, FEATURES, 4, forest.Settings(**params))
    theirs = mllib(rows, **params)
    assert own.importance() == pytest.approx(theirs.stages[-1].featureImportances.toArray(), abs=0.06)
    gap = F.aggregate(F.zip_with("t", "o", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda x, y: F.greatest(x, y))
    both = theirs.transform(rows).select(vector_to_array("probability").alias("t"), forest.probabilities(own)(feature_array(FEATURES)).alias("o"))
    assert both.agg(F.avg(gap)).first()[0] < 0.06


def test_a_model_does_not_depend_on_partitions(citations):
    from kerbstat.operators.features import load_features, training_frame

    frame = training_frame(load_features(citations))
    params = {"numTrees": 3, "maxDepth": 3}
    one, other = (fit_model(frame, params=params, partitions=n) for n in (3, 7))
    assert one.importance().collect() == other.importance().collect()


def test_tables_in_parts_add_up(rows, monkeypatch):
    settings = forest.Settings(**{**ONE_TREE, "numTrees": 4, "subsamplingRate": 0.8})
    whole = forest.fit_forest(rows, FEATURES, 4, settings)
    monkeypatch.setattr(forest, "ROWS", 100)
    monkeypatch.setattr(forest, "BLOCK", 1)
    parts = forest.fit_forest(rows, FEATURES, 4, settings, partitions=5)
    assert (whole.feature == parts.feature).all() and (whole.cut == parts.cut).all() and (whole.counts == parts.counts).all()


def test_features_that_come_together_are_counted_as_one():
    rng = np.random.default_rng(1)
    day = rng.integers(1, 8, 5000)
    bins = np.column_stack([day, rng.integers(0, 30, 5000), day > 5, rng.integers(0, 3, 5000), day % 3]).astype(np.uint8)
    sizes = np.array([8, 30, 2, 3, 3])
    groups = forest.joint_codes(bins, sizes, 30)
    assert len(groups) == 2 and sorted(len(ways) for _, ways in groups) == [21, 30]
    places = np.column_stack([ways[code] for code, ways in groups])
    assert (np.sort(places, axis=1) == bins + np.cumsum(sizes) - sizes).all()
    alone = forest.joint_codes(bins, sizes, 0)
    assert len(alone) == 5 and sum(len(ways) for _, ways in alone) == 7 + 30 + 2 + 3 + 3


def test_slices_and_joint_counts_do_not_matter(rows, monkeypatch):
    settings = forest.Settings(**{**ONE_TREE, "numTrees": 4, "subsamplingRate": 0.8})
    own = forest.joint_codes
    whole = forest.fit_forest(rows, FEATURES, 4, settings, partitions=1)
    monkeypatch.setattr(forest, "SLICE", 37)
    monkeypatch.setattr(forest, "joint_codes", lambda bins, sizes, limit: own(bins, sizes, 1 << 14))
    parts = forest.fit_forest(rows, FEATURES, 4, settings, partitions=2)
    assert (whole.feature == parts.feature).all() and (whole.cut == parts.cut).all() and (whole.counts == parts.counts).all()


def test_rare_numbers_of_draws_and_copies():
    key, s = np.arange(50_000, dtype=np.int64) * 104_729, forest.Settings(subsamplingRate=0.8)
    copies = np.where(np.arange(50_000) % 7 == 0, 9, 1)
    drawn, at = forest.weights(key, forest.alike(copies, s), 3, 42), forest.mixed(key, 42, 3)
    for n in (1, 9):
        least, cumulated = forest.chances(n, 0.8, True)
        assert (drawn[copies == n] == least + np.searchsorted(cumulated, at[copies == n], side="right")).all()
    assert drawn[copies == 1].max() > 5


def test_copies_are_drawn_as_often_as_rows():
    for bootstrap in (True, False):
        least, one = forest.chances(1, 0.8, bootstrap)
        start, three = forest.chances(3, 0.8, bootstrap)
        each = np.diff(one, prepend=0)
        whole = np.convolve(np.convolve(each, each), each)
        assert (least, start) == (0, 0)
        n = min(len(three), len(whole))
        assert np.cumsum(whole)[:n] == pytest.approx(three[:n], abs=1e-12)
    start, many = forest.chances(10**9, 0.8, True)
    assert start + np.searchsorted(many, 0.5) == pytest.approx(8e8, abs=2)
    key, copies = np.arange(20_000, dtype=np.int64) * 7919, np.array([1, 4] * 10_000)
    drawn = forest.weights(key, forest.alike(copies, forest.Settings(subsamplingRate=0.8)), 5, 42)
    assert drawn[0::2].mean() == pytest.approx(0.8, abs=0.03) and drawn[1::2].mean() == pytest.approx(3.2, abs=0.06)


def test_a_row_that_is_there_often_is_one_row_of_the_matrix(spark):
    frame = spark.range(1000).select(F.lit(1.0).alias("a"), (F.col("id") % 2).cast("int").alias("label"))
    own = forest.fit_forest(frame, ["a"], 2, forest.Settings(numTrees=2, maxDepth=2))
    assert (own.feature < 0).all()
    assert own.counts[:, 0].sum(axis=1) == pytest.approx([1000, 1000], abs=150)


def test_answers_are_means_over_the_leaves(spark, monkeypatch):
    rng = np.random.default_rng(5)
    grid = forest.Boosted(["a", "b"], [np.arange(6.0), np.arange(3.0)], 3)
    own = forest.Forest.empty(grid, 4, 3)
    own.counts[:] = rng.integers(0, 9, own.counts.shape)
    for tree, splits in enumerate(([], [0], [0, 1, 3, 4], [0, 2, 5])):  # a leaf alone, and trees that end early on either side
        for node in splits:
            own.feature[tree, node] = rng.integers(0, 2)
            own.cut[tree, node] = rng.integers(0, 4)
    values = np.column_stack([rng.integers(-1, 7, 50), rng.integers(-1, 4, 50)]).astype(float)
    values[::9, 0] = np.nan

    def plain(row):
        total = np.zeros(3)
        for feature, cut, counts in zip(own.feature, own.cut, own.counts, strict=True):
            node = 0
            while feature[node] >= 0:
                node = 2 * node + 1 + int(row[feature[node]] > cut[node])
            total += counts[node] / max(counts[node].sum(), 1)
        return total / total.sum()

    want = [plain(r) for r in grid.bins(values)]
    for rows in (forest.PART, 3):
        monkeypatch.setattr(forest, "PART", rows)
        found = forest.probabilities(own).func(pd.Series(list(values)))
        assert np.allclose(np.stack(found.to_numpy()), want, atol=1e-12)


def test_features_that_are_tried():
    subset = lambda strategy, trees=10: forest.Settings(numTrees=trees, featureSubsetStrategy=strategy).subset(18)
    assert [subset(s) for s in ("0.8", "all", "sqrt", "log2", "onethird", "auto", "3", "30")] == [15, 18, 5, 5, 6, 5, 3, 18]
    assert subset("auto", 1) == 18


def test_forests_that_mllib_fitted_are_read_still(spark, citations):
    from kerbstat.operators.features import load_features, training_frame

    frame = training_frame(load_features(citations))
    new = fit_model(frame, params={"numTrees": 2, "maxDepth": 2})
    encoded = new.encode(frame).join(new.label_frame().select("code", "value"), F.col("violation_code") == F.col("value"))
    labelled = encoded.withColumn("label", F.col("code").cast("double"))
    learner = RandomForestClassifier(numTrees=2, maxDepth=2, seed=1)
    fitted = Pipeline(stages=[VectorAssembler(inputCols=new.features, outputCol="features"), learner]).fit(labelled)
    old = ClassModel(fitted, new.vocabulary, new.labels, new.numeric, new.categorical)
    for model in (old, new):
        again = ClassModel.load(spark, model.save(f"{work_dir(spark)}/read-still"))
        assert type(again) is type(model)
        assert again.importance().collect() == model.importance().collect()
        answers = [sorted(map(str, predictions(m, frame.limit(50)).collect())) for m in (model, again)]
        assert answers[0] == answers[1]
