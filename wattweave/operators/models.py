"""Classifiers as MLlib pipelines, tuning by cross-validation and model reports.

Input rows carry ``features`` (complete ARRAY<DOUBLE>) and a label column. Every pipeline scales features with
statistics of its training rows, so a fold never sees its hold-out.
"""

from __future__ import annotations

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier,
                                       OneVsRest, RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, RFormula, SQLTransformer, StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattweave.operators.ranking import stratified_folds


def with_vector(df: DataFrame, features: str = "features") -> DataFrame:
    return df.withColumn("vector", array_to_vector(features))


def formula_features(df: DataFrame, formula: str) -> DataFrame:
    """Features and label by model formula, e.g. ``use ~ . - site_id``; text columns become indicator columns."""
    return RFormula(formula=formula, featuresCol="vector", labelCol="y").fit(df).transform(df)


def _label_index(label: str, labels: list[str]) -> SQLTransformer:
    """Add ``y``, the place of the label in the list: -1 for a class that is not listed, null for a null label.

    No row is lost: rows to be scored may have any label or none. Training rows need a listed label.
    """
    listed = ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in labels)
    return SQLTransformer(statement=f"SELECT *, CAST(array_position(array({listed}), CAST(`{label}` AS STRING)) - 1 AS DOUBLE) "
                                    "AS y FROM __THIS__")


def labelled(df: DataFrame, label: str) -> DataFrame:
    """The rows that can be learned from."""
    return df.where(F.col(label).isNotNull())


def _pipeline(label: str, labels: list[str], classifier, scale: bool = True) -> Pipeline:
    stages = [_label_index(label, labels)]
    if scale:
        stages.append(StandardScaler(inputCol="vector", outputCol="scaled", withMean=True, withStd=True))
    back = IndexToString(inputCol="prediction", outputCol="predicted", labels=labels)
    return Pipeline(stages=[*stages, classifier, back])


def class_labels(df: DataFrame, label: str) -> list[str]:
    """The classes in the order the label index gives them."""
    return sorted(str(r[0]) for r in df.where(F.col(label).isNotNull()).select(label).distinct().collect())


def _columns(scale: bool) -> dict[str, str]:
    return {"featuresCol": "scaled" if scale else "vector", "labelCol": "y"}


def boosted_trees(label: str, labels: list[str], rounds: int = 150, depth: int = 8, rate: float = 0.3,
                  seed: int = 100) -> Pipeline:
    """Gradient-boosted trees, one against the rest per class."""
    tree = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed, **_columns(False))
    model = OneVsRest(classifier=tree, **_columns(False)) if len(labels) > 2 else tree
    return _pipeline(label, labels, model, scale=False)


def perceptron(label: str, labels: list[str], n_features: int, hidden: int = 5, iterations: int = 100,
               seed: int = 100) -> Pipeline:
    """One hidden layer."""
    layers = [n_features, hidden, len(labels)]
    return _pipeline(label, labels, MultilayerPerceptronClassifier(
        layers=layers, maxIter=iterations, seed=seed, **_columns(True)))


def linear_svm(label: str, labels: list[str], cost: float, n_rows: int, iterations: int = 100) -> Pipeline:
    """Linear support vector machine, one against the rest; the cost C becomes the penalty 1 / (C n)."""
    machine = LinearSVC(regParam=1.0 / (cost * n_rows), maxIter=iterations, standardization=False, **_columns(True))
    model = OneVsRest(classifier=machine, **_columns(True)) if len(labels) > 2 else machine
    return _pipeline(label, labels, model)


def random_forest(label: str, labels: list[str], mtry: int, trees: int = 500, depth: int = 20,
                  seed: int = 100) -> Pipeline:
    """Random forest that tries ``mtry`` predictors per split."""
    return _pipeline(label, labels, RandomForestClassifier(
        numTrees=trees, maxDepth=depth, featureSubsetStrategy=str(mtry), seed=seed, **_columns(False)), scale=False)


def logistic(label: str, labels: list[str]) -> Pipeline:
    """Unpenalised binomial logistic regression; the second label in order is the one with probability p."""
    return _pipeline(label, labels, LogisticRegression(regParam=0.0, family="binomial", **_columns(True)))


def fit_binomial(df: DataFrame, flag: str, penalty: float = 0.0):
    """Generalised linear model of a 0/1 column with logit link; ``vector`` holds the predictors."""
    return GeneralizedLinearRegression(family="binomial", link="logit", labelCol=flag, featuresCol="vector",
                                       regParam=penalty, maxIter=50).fit(df)


def coefficient_report(model, names: list[str], spark) -> DataFrame:
    """(term, coefficient, std_error, t_value, p_value), the intercept last."""
    summary = model.summary
    terms = [*names, "(Intercept)"]
    estimates = [*model.coefficients, model.intercept]
    rows = [(t, float(c), float(e), float(z), float(p)) for t, c, e, z, p in
            zip(terms, estimates, summary.coefficientStandardErrors, summary.tValues, summary.pValues)]
    return spark.createDataFrame(
        rows, "term string, coefficient double, std_error double, t_value double, p_value double")


def predict(model: Model, df: DataFrame) -> DataFrame:
    """Add ``predicted`` (and ``probability`` where the model has one)."""
    return model.transform(df)


def cross_validate(df: DataFrame, label: str, key: str, candidates: dict[str, Pipeline], folds: int = 10,
                   seed: int = 100, parallelism: int = 2) -> tuple[PipelineModel, DataFrame]:
    """Accuracy of every candidate over class-balanced folds; the best one refitted on all rows, and the report."""
    folded = stratified_folds(labelled(df, label), label, key, folds, seed).cache()
    try:
        shell = Pipeline(stages=[])
        grid = [{shell.stages: p.getStages()} for p in candidates.values()]
        judge = MulticlassClassificationEvaluator(labelCol="y", predictionCol="prediction", metricName="accuracy")
        tuned = CrossValidator(estimator=shell, estimatorParamMaps=grid, evaluator=judge, numFolds=folds,
                               foldCol="fold", parallelism=parallelism).fit(folded)
    finally:
        folded.unpersist()
    return tuned.bestModel, tuning_report(tuned, list(candidates), df.sparkSession)


def tuning_report(tuned: CrossValidatorModel, names: list[str], spark) -> DataFrame:
    """(setting, accuracy, accuracy_sd, is_best) per grid point."""
    scores = tuned.avgMetrics
    best = scores.index(max(scores))
    rows = [(n, float(s), float(d), i == best) for i, (n, s, d) in enumerate(zip(names, scores, tuned.stdMetrics))]
    return spark.createDataFrame(rows, "setting string, accuracy double, accuracy_sd double, is_best boolean")
