"""Metrics against brute force, ties and empty ratios included."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kerbstat.operators import metrics

N = 6


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for _ in range(600):
        label = rng.choice([0, 0, 0, 1, 2, 3])
        probability = [rng.choice([0.0, 0.1, 0.1, 0.2, 0.4]) for _ in range(N)]
        out.append((label, rng.choice([0, 1, 2, 4]), probability))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "label int, prediction int, probability array<double>").repartition(3)


def ranking(probability):
    return sorted(range(len(probability)), key=lambda i: (probability[i], i), reverse=True)


def test_true_rank_and_top_classes(frame):
    got = metrics.top_classes(frame, 3).withColumn("rank", metrics.true_rank()).collect()
    assert len(got) == 600
    for r in got:
        order = ranking(r["probability"])
        assert r["rank"] == order.index(r["label"]) + 1
        assert [t["code"] for t in r["top"]] == order[:3]
        assert [t["probability"] for t in r["top"]] == [r["probability"][i] for i in order[:3]]


def test_top_classes_asks_for_more_than_there_are(frame):
    assert len(metrics.top_classes(frame, 50).first()["top"]) == N
    assert metrics.top_classes(frame.limit(0), 5).count() == 0


@pytest.mark.parametrize("batch", ["1", "3", "10000"])
def test_top_classes_with_gaps(spark, conf, batch):
    conf("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    arrays = [[0.1, 0.9], None, [0.5], [], [None, 0.3, 0.3], [0.2, 0.2, 0.2, 0.2], None, [0.0, 1.0]]
    frame = spark.createDataFrame(list(enumerate(arrays)), "i int, probability array<double>").repartition(2)
    got = {r["i"]: r["top"] for r in metrics.top_classes(frame, 3).collect()}
    for i, p in enumerate(arrays):
        if p is None:
            assert got[i] is None
            continue
        order = sorted((c for c in range(len(p)) if p[c] is not None), key=lambda c: (p[c], c), reverse=True)[:3]
        assert [(t["probability"], t["code"]) for t in got[i]] == [(p[c], c) for c in order]


def test_top_k(frame, rows):
    got = {r["k"]: r["accuracy"] for r in metrics.top_k_accuracy(frame, (1, 3, 5, 7)).collect()}
    want = {k: sum(l in ranking(p)[:k] for l, _, p in rows) / len(rows) for k in (1, 3, 5)}
    assert got == pytest.approx(want)


def test_per_class_and_averages(frame, rows):
    got = {r["class"]: tuple(r)[1:] for r in metrics.per_class(frame).collect()}
    want = {}
    for c in sorted({l for l, _, _ in rows} | {p for _, p, _ in rows}):
        hits = sum(l == p == c for l, p, _ in rows)
        predicted, support = sum(p == c for _, p, _ in rows), sum(l == c for l, _, _ in rows)
        precision, recall = hits / predicted if predicted else 0.0, hits / support if support else 0.0
        f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
        want[c] = (precision, recall, f1, support)
    assert got.keys() == want.keys() and 3 in got and 4 in got
    for c in got:
        assert got[c] == pytest.approx(want[c])
    means = {r["average"]: tuple(r)[1:] for r in metrics.averages(frame).collect()}
    assert means["macro"] == pytest.approx([sum(w[i] for w in want.values()) / len(want) for i in range(3)])
    assert means["weighted"] == pytest.approx([sum(w[i] * w[3] for w in want.values()) / len(rows) for i in range(3)])
    accuracy = metrics.accuracy(frame).first()[0]
    assert accuracy == sum(l == p for l, p, _ in rows) / len(rows)
    assert means["weighted"][1] == pytest.approx(accuracy)


def test_accuracy_equals_top_1_for_arg_max(frame):
    best = frame.withColumn("prediction", metrics_best(frame))
    assert metrics.accuracy(best).first()[0] == metrics.top_k_accuracy(best, (1,)).first()["accuracy"]


def metrics_best(frame):
    scores = F.col("probability")
    return (F.size(scores) - F.array_position(F.reverse(scores), F.array_max(scores))).cast("int")


def test_confusion_top(frame, rows):
    got = {(r["label"], r["prediction"]): r["pair_rows"] for r in metrics.confusion_top(frame, 1).collect()}
    assert got == {(0, p): sum(l == 0 and q == p for l, q, _ in rows) for p in {q for l, q, _ in rows if l == 0}}
    assert metrics.in_most_frequent(frame, "label", 1).select("label").distinct().count() == 1


def test_report(frame, spark):
    importance = spark.createDataFrame([(f"f{i}", float(i)) for i in range(20)], "feature string, importance double")
    lines = {(r["section"], r["name"]): r["value"] for r in metrics.report(frame, importance, (1, 3, 9)).collect()}
    assert lines["overall", "top_9_accuracy"] is None and lines["overall", "top_3_accuracy"] > 0
    assert {"accuracy", "macro_f1", "weighted_f1"} <= {n for s, n in lines if s == "overall"}
    features = [n for s, n in lines if s == "feature"]
    assert len(features) == 15 and "f19" in features and "f4" not in features
    assert lines["class 0", "support"] == frame.where("label = 0").count()
    names = spark.createDataFrame([("zero", 0), ("one", 1)], "value string, code int")
    named = {(r["section"], r["name"]): r["value"] for r in metrics.report(frame, names=names).collect()}
    assert named["class zero", "support"] == lines["class 0", "support"] and ("class 2", "recall") in named
    assert named["overall", "macro_precision"] == lines["overall", "macro_precision"]
    pairs = metrics.confusion_top(frame, 1, names).collect()
    assert {r["label_name"] for r in pairs} == {"zero"} and {r["prediction_name"] for r in pairs} >= {"zero", None}
