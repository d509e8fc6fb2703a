"""Class filters, split, vocabularies."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kerbstat.operators import classes, vocabulary
from kerbstat.session import stage


def test_rare_classes(spark):
    df = spark.createDataFrame(
        [(f"a{i}", "nine") for i in range(9)] + [(f"b{i}", "ten") for i in range(10)], "summons_number string, violation_code string"
    )
    assert {r[0] for r in classes.frequent_classes(df).select("violation_code").distinct().collect()} == {"ten"}
    assert tuple(classes.rare_class_rows(df).first()) == (9, 1)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows in one class, and classes of a few rows."""
    return spark.range(30_000).select(
        F.concat(F.lit("id-"), F.col("id").cast("string")).alias("summons_number"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 700).cast("string")).alias("violation_code"),
    )


def test_split_is_exact_per_class(skewed):
    split = stage(classes.stratified_split(skewed), "split")
    assert split.count() == skewed.count() == split.select("summons_number").distinct().count()
    sizes = {
        r["violation_code"]: (r["test"] or 0, r["validation"] or 0, r["train"] or 0)
        for r in split.groupBy("violation_code").pivot("split", ["test", "validation", "train"]).count().collect()
    }
    for test, validation, train in sizes.values():
        n = test + validation + train
        assert test == int(n * 0.2 + 0.5)
        assert validation == int((n - test) * 0.1 + 0.5)


def test_split_is_repeatable(skewed):
    one = classes.stratified_split(skewed)
    two = classes.stratified_split(skewed.repartition(11))
    assert one.exceptAll(two).count() == 0
    assert classes.stratified_split(skewed, seed=1).exceptAll(one).count() > 0


def test_split_ranks_edge_rows_only(skewed):
    """Rows are not shuffled on the way out: they meet the cuts of their class by broadcast."""
    plan = classes.stratified_split(skewed)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Window" not in plan


def test_vocabulary(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    words = stage(vocabulary.fit_vocabulary(df, ["c"]), "words")
    assert {r["value"]: r["code"] for r in words.collect()} == {"UNKNOWN": 0, "a": 1, "b": 2}
    new = spark.createDataFrame([("b",), ("zzz",), (None,), ("UNKNOWN",)], "c string")
    assert [r[0] for r in vocabulary.encode(new, words, ["c"]).collect()] == [2, 0, 0, 0]


def test_encode_without_broadcast(spark, conf, skewed):
    words = stage(vocabulary.fit_vocabulary(skewed, ["violation_code"]), "words")
    small = vocabulary.encode(skewed, words, ["violation_code"])
    want = {tuple(r) for r in small.collect()}
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    large = vocabulary.encode(skewed, words, ["violation_code"])
    assert "SortMergeJoin" in large._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in large.collect()} == want


def test_targets(spark):
    train = spark.createDataFrame([("1", "x"), ("2", "y")], "id string, t string")
    labels = stage(vocabulary.fit_labels(train, "t"), "labels")
    seen = spark.createDataFrame([("3", "y"), ("4", "new"), ("5", "new")], "id string, t string")
    encoded = vocabulary.encode_target(seen, labels, "t")
    assert [(r["id"], r["label"]) for r in encoded.collect()] == [("3", 1)]
    assert [tuple(r) for r in vocabulary.unseen_targets(seen, labels, "t").collect()] == [("new", 2)]
    assert vocabulary.decode(encoded, labels, "label", "name").first()["name"] == "y"


def test_most_frequent_breaks_ties_by_class(spark):
    df = spark.createDataFrame([(c,) for c in (3, 3, 1, 1, 2)], "label int")
    assert [r[0] for r in classes.most_frequent(df, "label", 2).collect()] == [1, 3]


def test_split_does_not_depend_on_the_bucket_depth(skewed, monkeypatch):
    want = classes.stratified_split(skewed).collect()
    monkeypatch.setattr(classes, "BUCKET_DIGITS", 1)
    assert sorted(map(tuple, classes.stratified_split(skewed).collect()), key=str) == sorted(map(tuple, want), key=str)


def test_numbers_run_on_across_ranges(spark, conf):
    conf("spark.sql.adaptive.enabled", "false")
    conf("spark.sql.shuffle.partitions", "5")
    values = [f"{i:04d}" for i in range(300)]
    df = spark.createDataFrame([(v, "x") for v in values * 2], "t string, u string")
    codes = {r["value"]: r["code"] for r in vocabulary.fit_labels(df, "t").collect()}
    assert codes == {v: i for i, v in enumerate(values)}
    both = {(r["feature"], r["value"]): r["code"] for r in vocabulary.fit_vocabulary(df, ["t", "u"]).collect()}
    assert both["t", "0299"] == 299 and both["t", "UNKNOWN"] == 300 and both["u", "UNKNOWN"] == 0 and both["u", "x"] == 1


def test_tiny_classes_and_rows_without_a_class(spark):
    df = spark.createDataFrame(
        [("a", "one"), ("b", "two"), ("c", "two"), ("d", None)], "summons_number string, violation_code string"
    )
    split = {r["summons_number"]: r["split"] for r in classes.stratified_split(df).collect()}
    assert split == {"a": "train", "b": "train", "c": "train", "d": None}
