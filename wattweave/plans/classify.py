"""Classify a building's primary use: features, stratified hold-out, fitted model, confusion matrix."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattweave.operators.discriminant import fit_discriminant
from wattweave.operators.evaluation import accuracy, confusion
from wattweave.operators.forest import fit_forest
from wattweave.operators.models import labelled, predict, with_vector
from wattweave.operators.ranking import stratified_split
from wattweave.sources.shared import materialise


@dataclass(frozen=True)
class Outcome:
    scored: DataFrame
    accuracy: DataFrame
    confusion: DataFrame


def hold_out(frame: DataFrame, label: str, key: str, share: float = 0.7, seed: int = 356) -> tuple[DataFrame, DataFrame]:
    """Training and test rows. The frame is written out first: models read it many times."""
    parts = materialise(stratified_split(frame, label, key, share, seed))
    return parts.where("is_train").drop("is_train"), parts.where(~F.col("is_train")).drop("is_train")


def evaluate(scored: DataFrame, label: str, predicted: str = "predicted") -> Outcome:
    return Outcome(scored, accuracy(scored, label, predicted), confusion(scored, label, predicted))


def classify(train: DataFrame, test: DataFrame, label: str, pipeline: Pipeline) -> Outcome:
    model = pipeline.fit(with_vector(labelled(train, label)))
    return evaluate(predict(model, with_vector(test)), label)


def classify_by_discriminant(train: DataFrame, test: DataFrame, label: str) -> Outcome:
    model = fit_discriminant(train, label)
    return evaluate(model.transform(test, prediction="predicted"), label)


def classify_by_forest(train: DataFrame, test: DataFrame, label: str, mtry: int, trees: int = 500, depth: int = 20) -> Outcome:
    return evaluate(fit_forest(train, label, mtry, trees, depth).transform(test), label)
