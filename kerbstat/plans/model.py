"""The class model: fitting, prediction, importance, saving and loading."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Any, ClassVar
from uuid import uuid4

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kerbstat.operators.features import feature_columns
from kerbstat.operators.metrics import top_classes
from kerbstat.operators.vocabulary import encode, encode_target, fit_labels, fit_vocabulary
from kerbstat.plans import boosting, forest
from kerbstat.schema import CODE, ID
from kerbstat.session import stage

# One training contract for both learners: 200 trees of depth 8, at least five rows in a leaf (boosted: second
# derivatives of five), four fifths of the rows and of the features for each tree.
FOREST = {
    "numTrees": 200,
    "maxDepth": 8,
    "minInstancesPerNode": 5,
    "subsamplingRate": 0.8,
    "featureSubsetStrategy": "0.8",
    "maxBins": 64,
    "seed": 42,
}


@dataclass
class ClassModel:
    """A fitted model with the vocabularies that lead to and from its numbers.

    The class itself is that of forests which MLlib fitted and which were saved as a ``pipeline``.
    """

    pipeline: PipelineModel | None
    vocabulary: DataFrame
    labels: list[str]
    numeric: list[str]
    categorical: list[str]
    target: str = CODE
    learner: ClassVar[str] = "forest"

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    def encode(self, frame: DataFrame) -> DataFrame:
        return encode(frame, self.vocabulary, self.categorical)

    def label_frame(self) -> DataFrame:
        """``(feature, value, code)`` of the classes."""
        rows = [(self.target, value, code) for code, value in enumerate(self.labels)]
        return self.vocabulary.sparkSession.createDataFrame(rows, "feature string, value string, code int")

    def predict(self, encoded: DataFrame) -> DataFrame:
        """Add ``prediction`` (class number) and ``probability`` (one entry per class)."""
        assembler, fitted = self.pipeline.stages
        scored = fitted.transform(assembler.transform(encoded))
        return scored.select(
            *[F.col(c) for c in encoded.columns],
            F.col("prediction").cast("int").alias("prediction"),
            vector_to_array("probability").alias("probability"),
        )

    def name_of(self, code: Column) -> Column:
        """Class name of a class number."""
        return F.element_at(F.array(*[F.lit(v) for v in self.labels]), code.cast("int") + 1)

    def predict_names(self, encoded: DataFrame, k: int = 5) -> DataFrame:
        """Add the predicted class by name, its confidence and the ``k`` likeliest classes.

        ``top_predictions`` is an array of (class, probability), likeliest first.
        """
        scored = top_classes(self.predict(encoded), k)
        named = F.transform(
            "top", lambda t: F.struct(self.name_of(t["code"]).alias(self.target), t["probability"].alias("probability"))
        )
        return scored.select(
            *encoded.columns,
            self.name_of(F.col("prediction")).alias("predicted"),
            F.element_at("probability", F.col("prediction") + 1).alias("confidence"),
            named.alias("top_predictions"),
        )

    def importance(self) -> DataFrame:
        """``(feature, importance)``, most important first."""
        rows = [(name, float(share)) for name, share in zip(self.features, self._shares(), strict=True)]
        table = self.vocabulary.sparkSession.createDataFrame(rows, "feature string, importance double")
        return table.orderBy(F.desc("importance"), "feature")

    def _shares(self) -> np.ndarray:
        return self.pipeline.stages[-1].featureImportances.toArray()

    def info(self, n: int = 15) -> DataFrame:
        """Target, feature names, number of classes and the ``n`` leading features, one row."""
        top = self.importance().limit(n)
        ranked = F.sort_array(F.collect_list(F.struct("importance", "feature")), asc=False)
        return top.agg(
            F.lit(self.target).alias("target"),
            F.array(*[F.lit(f) for f in self.features]).alias("features"),
            F.lit(len(self.labels)).alias("num_classes"),
            ranked.alias("top_features"),
        )

    def save(self, root: str, version: str | None = None) -> str:
        """Save under ``root`` and return the folder; the facts come last and mark it whole.

        A version is named by time, to the microsecond, and a random part; one that exists is refused.
        """
        version = version or f"{datetime.now(timezone.utc):%Y%m%d_%H%M%S_%f}_{uuid4().hex[:8]}"
        path = f"{root.rstrip('/')}/{version}"
        # The first write claims the folder: it fails if the version is there already.
        self.vocabulary.write.mode("error").parquet(f"{path}/vocabulary")
        self._save_trees(path)
        facts = self.vocabulary.sparkSession.createDataFrame(
            [(self.target, self.numeric, self.categorical, self.labels, self.learner)], FACTS
        )
        facts.coalesce(1).write.mode("error").parquet(f"{path}/facts")
        return path

    def _save_trees(self, path: str) -> None:
        self.pipeline.write().save(f"{path}/pipeline")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ClassModel:
        """A saved model, of the class of its learner."""
        facts = spark.read.schema(FACTS).parquet(f"{path}/facts").first()
        own = {
            "vocabulary": spark.read.parquet(f"{path}/vocabulary"),
            "labels": list(facts["labels"]),
            "numeric": list(facts["numeric"]),
            "categorical": list(facts["categorical"]),
            "target": facts["target"],
        }
        if facts["learner"] == ClassModel.learner:
            return ClassModel(PipelineModel.load(f"{path}/pipeline"), **own)
        found = {r["feature"]: np.array(r["edges"]) for r in spark.read.parquet(f"{path}/edges").collect()}
        features, classes = [*own["numeric"], *own["categorical"]], len(own["labels"])
        edges = [found[f] for f in features]
        if facts["learner"] == ForestModel.learner:
            trees = spark.read.schema(forest.NODES).parquet(f"{path}/trees")
            return ForestModel(None, **own, forest=forest.from_nodes(trees, boosting.Boosted(features, edges, classes)))
        trees = spark.read.schema(boosting.NODES).parquet(f"{path}/trees")
        return BoostedModel(None, **own, boosted=boosting.from_nodes(trees, features, edges, classes))

    @classmethod
    def load_latest(cls, spark: SparkSession, root: str) -> ClassModel:
        """The saved model whose folder name is the largest."""
        root = root.rstrip("/")
        files = spark.read.schema(FACTS).parquet(f"{root}/*/facts")
        version = F.regexp_extract("_metadata.file_path", r"/([^/]+)/facts/[^/]+$", 1)
        return cls.load(spark, f"{root}/{files.agg(F.max(version)).first()[0]}")


def with_chances(encoded: DataFrame, chances: Column) -> DataFrame:
    """The rows with ``prediction``, the first of the likeliest classes, and ``probability``."""
    rows = encoded.select(*[F.col(c) for c in encoded.columns], chances.alias("probability"))
    best = F.array_position("probability", F.array_max("probability")) - 1
    return rows.select(*[F.col(c) for c in encoded.columns], best.cast("int").alias("prediction"), "probability")


def save_edges(spark: SparkSession, grid: boosting.Boosted, path: str) -> None:
    edges = [(f, e.tolist()) for f, e in zip(grid.features, grid.edges, strict=True)]
    spark.createDataFrame(edges, "feature string, edges array<double>").coalesce(1).write.parquet(f"{path}/edges")


@dataclass
class ForestModel(ClassModel):
    """A random forest over histograms; ``pipeline`` is not used."""

    forest: forest.Forest | None = None
    learner: ClassVar[str] = "histogram forest"

    def predict(self, encoded: DataFrame) -> DataFrame:
        return with_chances(encoded, forest.probabilities(self.forest)(boosting.feature_array(self.features)))

    def _shares(self) -> np.ndarray:
        return self.forest.importance()

    def _save_trees(self, path: str) -> None:
        spark = self.vocabulary.sparkSession
        forest.nodes_frame(spark, self.forest).write.parquet(f"{path}/trees")
        save_edges(spark, self.forest.grid, path)


@dataclass
class BoostedModel(ClassModel):
    """A model of boosted trees; ``pipeline`` is not used."""

    boosted: boosting.Boosted | None = None
    learner: ClassVar[str] = "boosted"

    def predict(self, encoded: DataFrame) -> DataFrame:
        return with_chances(encoded, boosting.probabilities(self.boosted)(boosting.feature_array(self.features)))

    def nodes(self) -> DataFrame:
        """Every node of every tree: feature number, cut, gain, cover, values."""
        return boosting.nodes_frame(self.vocabulary.sparkSession, self.boosted)

    def split_importance(self) -> DataFrame:
        """``(feature, importance, splits, gain, cover)``: by the mean gain of the splits on a feature."""
        return boosting.split_importance(self.nodes(), self.features)

    def importance(self) -> DataFrame:
        return self.split_importance().select("feature", "importance")

    def staged_scores(self, frame: DataFrame, part: str = "split") -> DataFrame:
        """Loss and error after every round on the parts of a training frame; see :mod:`kerbstat.plans.boosting`."""
        encoded = encode_target(self.encode(frame), self.label_frame(), self.target)
        return boosting.staged_scores(encoded, self.boosted, part)

    def _save_trees(self, path: str) -> None:
        self.nodes().write.parquet(f"{path}/trees")
        save_edges(self.vocabulary.sparkSession, self.boosted, path)


FACTS = "target string, numeric array<string>, categorical array<string>, labels array<string>, learner string"


def fit_model(
    train: DataFrame,
    target: str = CODE,
    learner: str = "forest",
    params: dict[str, Any] | None = None,
    exclude: tuple[str, ...] = (),
    seed: int = 42,
    partitions: int | None = None,
) -> ClassModel:
    """Fit vocabularies and a model on a training frame.

    ``learner`` is ``forest``, whose ``params`` are those of :class:`kerbstat.plans.forest.Settings`, or ``boosted``, whose
    are those of :class:`kerbstat.plans.boosting.Settings`; they override the contract's. ``exclude`` leaves features out.
    ``partitions`` is that of a forest's rows (else Spark's choice); one seed gives one model, whatever their number.
    """
    numeric, categorical = (
        [c for c in columns if c not in exclude] for columns in feature_columns(train.columns, target)
    )
    vocabulary = stage(fit_vocabulary(train, categorical), "vocabulary")
    labels = stage(fit_labels(train, target), "labels")
    names = [row["value"] for row in labels.orderBy("code").collect()]
    encoded = encode_target(encode(train, vocabulary, categorical), labels, target)
    matrix = stage(encoded.select(ID, *numeric, *categorical, "label"), "matrix")
    if learner == BoostedModel.learner:
        settings = boosting.Settings(**{"seed": seed, **(params or {})})
        boosted = boosting.fit_boosted(matrix, [*numeric, *categorical], len(names), settings, ID)
        return BoostedModel(None, vocabulary, names, numeric, categorical, target, boosted)
    if learner != "forest":
        raise ValueError(f"no learner is called {learner}")
    settings = forest.Settings(**{**FOREST, "seed": seed, **(params or {})})
    grown = forest.fit_forest(matrix.drop(ID), [*numeric, *categorical], len(names), settings, partitions)
    return ForestModel(None, vocabulary, names, numeric, categorical, target, grown)


def predictions(model: ClassModel, frame: DataFrame) -> DataFrame:
    """``(id, label, prediction, probability)`` of a training frame; unseen classes are left out."""
    encoded = encode_target(model.encode(frame), model.label_frame(), model.target)
    keys = [c for c in (ID, "split") if c in frame.columns]
    return model.predict(encoded).select(*keys, "label", "prediction", "probability")
