"""Softmax boosting against a plain version that looks at every row and every cut."""

from __future__ import annotations

import pickle
import subprocess
import sys
from dataclasses import replace
from uuid import uuid4

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from kerbstat.operators.features import load_features, training_frame
from kerbstat.plans import boosting
from kerbstat.plans.boosting import UNIT, Boosted, Settings
from kerbstat.plans.model import BoostedModel, ClassModel, fit_model, predictions
from kerbstat.plans.training import run_training
from kerbstat.session import stage, work_dir
from tests.test_model import SMALL_FOREST

FEATURES = ["a", "b", "c"]
SETTINGS = Settings(rounds=3, depth=3, child_weight=1.0, subsample=1.0, colsample=1.0, max_bins=16, stored=2)


def plain_tree(values, label, margins, s):
    """``(leaf value per row, gains by feature)`` of one tree, by recursion over all rows."""
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    hot = np.eye(margins.shape[1])[label]
    g, h = np.rint((p - hot) * UNIT) / UNIT, np.rint(np.maximum(2 * p * (1 - p), 2 / UNIT) * UNIT) / UNIT
    out, gains = np.zeros_like(margins), []

    def score(rows):
        return (g[rows].sum(axis=0) ** 2 / (h[rows].sum(axis=0) + s.ridge)).sum()

    def split(rows, depth):
        out[rows] = -s.rate * g[rows].sum(axis=0) / (h[rows].sum(axis=0) + s.ridge)
        best = (1e-9, None, None)
        for f in range(values.shape[1]) if depth < s.depth else ():
            v = np.nan_to_num(values[rows, f], nan=-np.inf)
            for cut in np.unique(v)[:-1]:
                left, right = rows[v <= cut], rows[v > cut]
                if min(h[left].sum(), h[right].sum()) < s.child_weight:
                    continue
                gain = 0.5 * (score(left) + score(right) - score(rows))
                if gain > best[0] + 1e-9:
                    best = (gain, f, (left, right))
        if best[1] is not None:
            gains.append((best[1], best[0]))
            for part in best[2]:
                split(part, depth + 1)

    split(np.arange(len(label)), 0)
    return out, gains


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        a, b, c = int(rng.integers(0, 7)), float(rng.integers(0, 12)) / 4, int(rng.integers(0, 3))
        label = (a + 2 * (b > 1.5) + c * (rng.random() < 0.7)) % 4
        rows.append((f"r{i}", a if i % 11 else None, b, c, int(label), "train" if i % 3 else "test"))
    frame = spark.createDataFrame(rows, "summons_number string, a int, b double, c int, label int, split string")
    values = np.array([[np.nan if x is None else x for x in r[1:4]] for r in rows], dtype=float)
    return stage(frame, "table"), values, np.array([r[4] for r in rows])


def test_rounds_equal_a_plain_version(table):
    frame, values, label = table
    boosted = boosting.fit_boosted(frame, FEATURES, 4, SETTINGS)
    margins = np.zeros((len(label), 4))
    for number, found in enumerate(boosted.margins(boosted.bins(values))):
        added, gains = plain_tree(values, label, margins, SETTINGS)
        margins = margins + added
        assert np.abs(found - margins).max() < 1e-9
        tree = boosted.trees[number]
        own = sorted((int(f), float(x)) for f, x in zip(tree.feature, tree.gain, strict=True) if f >= 0)
        assert [f for f, _ in own] == [f for f, _ in sorted(gains)]
        assert [x for _, x in own] == pytest.approx([x for _, x in sorted(gains)])


def test_partitions_and_stored_margins_do_not_matter(table):
    frame = table[0]
    s = replace(SETTINGS, subsample=0.7, colsample=0.67)
    fits = [boosting.fit_boosted(f, FEATURES, 4, replace(s, stored=n)) for f, n in ((frame.coalesce(1), 10), (frame.repartition(5), 1))]
    for one, two in zip(fits[0].trees, fits[1].trees, strict=True):
        assert (one.feature == two.feature).all() and (one.cut == two.cut).all() and (one.value == two.value).all()


def test_scores_after_each_round_are_those_of_shorter_fits(table):
    frame, values, label = table
    boosted = boosting.fit_boosted(frame, FEATURES, 4, SETTINGS)
    got = {(r["split"], r["round"]): r for r in boosting.staged_scores(frame, boosted).collect()}
    assert len(got) == 2 * SETTINGS.rounds
    parts = np.array([r["split"] for r in frame.collect()])
    order = [(r["a"], r["b"], r["c"], r["label"]) for r in frame.collect()]
    own = np.array([[np.nan if x is None else x for x in r[:3]] for r in order], dtype=float)
    labels = np.array([r[3] for r in order])
    for number in range(1, SETTINGS.rounds + 1):
        short = boosting.fit_boosted(frame, FEATURES, 4, replace(SETTINGS, rounds=number))
        p = boosting.softmax(short.final_margins(short.bins(own)))
        for part in ("train", "test"):
            mine = parts == part
            r = got[part, number]
            assert r["rows"] == mine.sum()
            assert r["logloss"] == pytest.approx(-np.log(p[mine, labels[mine]]).mean())
            assert r["error"] == pytest.approx((p[mine].argmax(axis=1) != labels[mine]).mean())


def test_importance_is_the_mean_gain(table, spark):
    boosted = boosting.fit_boosted(table[0], FEATURES, 4, SETTINGS)
    nodes = boosting.nodes_frame(spark, boosted)
    nodes.createOrReplaceTempView("nodes")
    want = spark.sql("SELECT feature, count(*) AS n, avg(gain) AS gain, avg(cover) AS cover FROM nodes WHERE feature >= 0 GROUP BY feature").collect()
    want = {FEATURES[r["feature"]]: r for r in want}
    got = boosting.split_importance(nodes, FEATURES).collect()
    assert [r["importance"] for r in got] == sorted((r["importance"] for r in got), reverse=True)
    assert sum(r["importance"] for r in got) == pytest.approx(1)
    total = sum(r["gain"] for r in want.values())
    for r in got:
        if r["feature"] in want:
            w = want[r["feature"]]
            assert (r["splits"], r["gain"], r["cover"]) == (w["n"], pytest.approx(w["gain"]), pytest.approx(w["cover"]))
            assert r["importance"] == pytest.approx(w["gain"] / total)
    back = boosting.from_nodes(nodes, FEATURES, boosted.edges, 4)
    bins = boosted.bins(table[1])
    assert (back.final_margins(bins) == boosted.final_margins(bins)).all()


def test_many_values_are_cut_at_quantiles(spark):
    frame = spark.range(5_000).select(F.col("id").cast("double").alias("x"), F.lit(None).cast("double").alias("none"), F.lit(1.0).alias("one"))
    edges = boosting.bin_edges(frame, ["x", "none", "one"], 16)
    assert 10 <= len(edges[0]) <= 15 and np.abs(np.diff(edges[0]) - 5000 / 16).max() < 100
    assert len(edges[1]) == len(edges[2]) == 0
    own = Boosted(["x", "none", "one"], edges, 2)
    assert own.bins(np.array([[-1.0, np.nan, 1.0], [1e9, 5.0, np.nan]])).tolist() == [[1, 0, 1], [len(edges[0]) + 1, 1, 0]]


def test_an_empty_table_and_one_class(spark):
    schema = "summons_number string, a int, b double, c int, label int"
    none = boosting.fit_boosted(spark.createDataFrame([], schema), FEATURES, 2, SETTINGS)
    assert (none.final_margins(none.bins(np.zeros((2, 3)))) == 0).all()
    one = boosting.fit_boosted(spark.createDataFrame([("x", 1, 1.0, 1, 0)] * 9, schema), FEATURES, 1, SETTINGS)
    assert boosting.softmax(one.final_margins(one.bins(np.zeros((2, 3))))).tolist() == [[1.0], [1.0]]


@pytest.fixture(scope="module")
def run(spark, citations):
    root = f"{work_dir(spark)}/models-{uuid4().hex}"
    return run_training(citations, learner="boosted", params={"rounds": 6, "depth": 4, "max_bins": 64}, output=root), root


def test_training_job(run, spark):
    job, root = run
    scores = {(r["split"], r["round"]): r for r in job.rounds().collect()}
    assert {k[0] for k in scores} == {"train", "validation", "test"} and max(k[1] for k in scores) == 6
    losses = [scores["train", n]["logloss"] for n in range(1, 7)]
    assert losses == sorted(losses, reverse=True)
    right = {r["split"]: r["accuracy"] for r in job.scores.collect()}
    assert right["test"] == pytest.approx(1 - scores["test", 6]["error"])
    again = ClassModel.load_latest(spark, root)
    assert isinstance(again, BoostedModel)
    held = job.parts.where("split = 'test'")
    one, two = (sorted((r["summons_number"], r["prediction"], tuple(r["probability"])) for r in predictions(m, held).collect()) for m in (job.model, again))
    assert one == two
    assert again.importance().collect() == job.model.importance().collect()
    assert {s for s in job.report().select("section").distinct().toPandas()["section"]} >= {"overall", "feature"}


def test_no_worse_than_a_forest(run, citations):
    job, _ = run
    forest = fit_model(job.parts.where("split = 'train'").drop("split"), params=SMALL_FOREST)
    held = job.parts.where("split = 'test'")
    shares = [predictions(m, held).agg(F.avg((F.col("label") == F.col("prediction")).cast("int"))).first()[0] for m in (job.model, forest)]
    assert shares[0] >= shares[1]


def test_the_query_fits_the_whole_contract(spark, monkeypatch):
    from checks import registry

    asked = {}

    def training(citations, **options):
        asked.update(options)
        raise StopIteration

    monkeypatch.setattr(registry, "run_training", training)
    monkeypatch.setattr(registry, "citations_from_tpch", lambda spark, path, columns: None)
    with pytest.raises(StopIteration):
        registry.QUERIES["boosted_predict"](spark, "nowhere")
    settings = Settings(**(asked.get("params") or {}))
    assert asked["learner"] == "boosted" and not asked.get("sample")
    assert settings == Settings() and (settings.rounds, settings.depth, settings.rate, settings.max_bins) == (200, 8, 0.1, 256)


def test_tasks_get_no_tree_that_is_in_the_stored_margins(table, monkeypatch):
    frame, sent = table[0], []

    def noted(self, work, schema):
        sent.append(len(cloudpickle.dumps(work)))
        raise StopIteration

    monkeypatch.setattr(type(frame), "mapInArrow", noted)
    for number in (0, 50):
        boosted = Boosted(FEATURES, [np.arange(5.0)] * 3, 4, [boosting.Tree.empty(8, 4) for _ in range(number)])
        with pytest.raises(StopIteration):
            boosting.grow(frame, boosted, number, SETTINGS)
    assert sent[1] < sent[0] + 1000


def test_unknown_learner_and_rounds_of_a_forest(citations):
    frame = training_frame(load_features(citations.limit(200)))
    with pytest.raises(ValueError, match="no learner"):
        fit_model(frame, learner="bosted")


def test_tasks_need_no_package(table, tmp_path, monkeypatch):
    """What executors run loads, and answers, in a process that can't import the package."""
    frame = table[0]
    sent, rows, groups = [], type(frame), type(frame.groupBy())

    def noted(kind, name):
        own = getattr(kind, name)
        monkeypatch.setattr(kind, name, lambda self, work, schema: sent.append(work) or own(self, work, schema))

    noted(rows, "mapInArrow")
    noted(groups, "applyInPandas")
    settings = replace(SETTINGS, rounds=2, stored=1)
    boosted = boosting.fit_boosted(frame, FEATURES, 4, settings)
    boosting.staged_scores(frame, boosted)
    chances = boosting.probabilities(boosted).func
    values = pd.Series([[1.0, 2.0, 3.0], [float("nan"), 0.0, 9.0]])
    for i, work in enumerate([*sent, chances]):
        (tmp_path / f"{i:03}").write_bytes(cloudpickle.dumps(work))
    (tmp_path / "values").write_bytes(pickle.dumps(values))
    script = """if 1:
        import pickle, pathlib
        *works, values = [pickle.loads(p.read_bytes()) for p in sorted(pathlib.Path().iterdir())]
        print(len(works), works[-1](values).map(list).tolist())
    """
    done = subprocess.run([sys.executable, "-I", "-c", script], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split(" ", 1) == [str(len(sent) + 1), f"{chances(values).map(list).tolist()}\n"]
    assert len(sent) >= 2 + 2 * settings.rounds
