"""Training and evaluation from the citation table to a saved model and a report."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, functions as F

from kerbstat.operators.classes import frequent_classes, rare_class_rows, stratified_split
from kerbstat.operators.features import load_features, training_frame
from kerbstat.operators.metrics import report
from kerbstat.operators.vocabulary import unseen_targets
from kerbstat.plans.model import BoostedModel, ClassModel, fit_model, predictions
from kerbstat.schema import CODE, COLUMN_ROLES
from kerbstat.session import stage

EVALUATION_SEED = 43


@dataclass
class TrainingRun:
    """What a training job leaves behind."""

    model: ClassModel
    removed: DataFrame
    split_sizes: DataFrame
    scores: DataFrame
    held_out: DataFrame
    parts: DataFrame
    path: str | None

    def report(self) -> DataFrame:
        """The metric report on the held-out rows, none of which the model was fitted on."""
        return report(self.held_out, self.model.importance(), names=self.model.label_frame())

    def rounds(self) -> DataFrame:
        """``(split, round, rows, logloss, error)`` of a boosted model: how each part did after every round."""
        if not isinstance(self.model, BoostedModel):
            raise ValueError("only a boosted model is made in rounds")
        return self.model.staged_scores(self.parts)


def run_training(
    citations: DataFrame,
    start: str | None = None,
    end: str | None = None,
    sample: float | None = None,
    include_coordinates: bool = False,
    target: str = CODE,
    learner: str = "forest",
    params: dict[str, Any] | None = None,
    exclude: tuple[str, ...] = (),
    least_rows: int = 10,
    output: str | None = None,
    seed: int = 42,
    partitions: int | None = None,
) -> TrainingRun:
    """Load, derive features, drop rare classes, split, fit, score the held-out parts, save.

    ``held_out`` has the predictions of the test and validation rows, ``scores`` their accuracy.
    ``seed`` is that of the sample, the split and the learner. Split rows and predictions are staged,
    so that the split is computed, and the held-out rows are scored, once.
    """
    if target not in COLUMN_ROLES["target_candidates"]:
        raise ValueError(f"{target} is no target; choose one of {', '.join(COLUMN_ROLES['target_candidates'])}")
    features = load_features(citations, start, end, sample, include_coordinates, seed)
    frame = stage(training_frame(features, target), "frame")
    parts = stage(stratified_split(frequent_classes(frame, target, least_rows), target, seed=seed), "parts")
    train = parts.where(F.col("split") == "train").drop("split")
    model = fit_model(train, target, learner, params, exclude, seed, partitions)
    held_out = stage(predictions(model, parts.where(F.col("split") != "train")), "predictions")
    scores = held_out.groupBy("split").agg(
        F.count("*").alias("rows"),
        (F.count_if(F.col("label") == F.col("prediction")) / F.count("*")).alias("accuracy"),
    )
    return TrainingRun(
        model=model,
        removed=rare_class_rows(frame, target, least_rows),
        split_sizes=parts.groupBy("split").agg(F.count("*").alias("rows")),
        scores=scores,
        held_out=held_out,
        parts=parts,
        path=model.save(output) if output else None,
    )


def evaluation_frame(citations: DataFrame, target: str = CODE, sample: float | None = 0.1, seed: int = EVALUATION_SEED) -> DataFrame:
    """The rows of an evaluation: a sample that is independent of a training job's."""
    return training_frame(load_features(citations, sample=sample, seed=seed), target)


def run_evaluation(
    citations: DataFrame, model: ClassModel, sample: float | None = 0.1, seed: int = EVALUATION_SEED
) -> tuple[DataFrame, DataFrame]:
    """The metric report of a model on a sample, and the classes it does not know.

    The sample is independent of that of :func:`run_training`, whose seed is another, but may hold
    rows the model was fitted on; ``TrainingRun.report`` has the held-out rows alone.
    """
    frame = evaluation_frame(citations, model.target, sample, seed)
    lines = report(predictions(model, frame), model.importance(), names=model.label_frame())
    return lines, unseen_targets(frame, model.label_frame(), model.target)
