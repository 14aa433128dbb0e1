"""Discriminant analysis and nearest neighbours as Spark ML estimators, so that they enter a CrossValidator."""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattweave.operators.discriminant import DiscriminantModel, fit_discriminant
from wattweave.operators.knn import Sizes, knn_regress
from wattweave.operators.models import class_labels, labelled, tuning_report
from wattweave.operators.ranking import stratified_folds
from wattweave.sources.shared import materialise


class _DiscriminantParams(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    def _columns(self, features: str, label: str, prediction: str) -> None:
        self._set(featuresCol=features, labelCol=label, predictionCol=prediction)


class Discriminant(Estimator, _DiscriminantParams):
    """Linear discriminant analysis; the label is a class number as a double."""

    def __init__(self, features: str = "features", label: str = "y", prediction: str = "prediction"):
        super().__init__()
        self._columns(features, label, prediction)

    def _fit(self, dataset: DataFrame) -> DiscriminantScorer:
        model = DiscriminantScorer(fit_discriminant(dataset.withColumn("__class", F.col(self.getLabelCol()).cast("int")), "__class", self.getFeaturesCol()))
        model._columns(self.getFeaturesCol(), self.getLabelCol(), self.getPredictionCol())
        return model


class DiscriminantScorer(Model, _DiscriminantParams):
    def __init__(self, fitted: DiscriminantModel):
        super().__init__()
        self.fitted = fitted

    def _transform(self, dataset: DataFrame) -> DataFrame:
        scored = self.fitted.transform(dataset, self.getFeaturesCol(), "__class")
        scored = scored.withColumnRenamed("probability", "class_probability")  # evaluators take that name for a vector
        return scored.withColumn(self.getPredictionCol(), F.col("__class").cast("double")).drop("__class")


class _NeighbourParams(HasLabelCol, HasPredictionCol):
    k = Param(Params._dummy(), "k", "number of neighbours", TypeConverters.toInt)
    keyCol = Param(Params._dummy(), "keyCol", "unique key of the rows", TypeConverters.toString)


class NearestNeighbours(Estimator, _NeighbourParams):
    """Regression on the k nearest rows by centred and scaled features; the rows are the model."""

    def __init__(self, key: str, label: str, k: int = 9, prediction: str = "prediction", sizes: Sizes = Sizes()):
        super().__init__()
        self.sizes = sizes
        self._set(keyCol=key, labelCol=label, k=k, predictionCol=prediction)

    def _fit(self, dataset: DataFrame) -> NeighbourModel:
        model = NeighbourModel(dataset, self.sizes)
        model._set(**{name: self.getOrDefault(name) for name in ("keyCol", "labelCol", "k", "predictionCol")})
        return model


class NeighbourModel(Model, _NeighbourParams):
    def __init__(self, train: DataFrame, sizes: Sizes = Sizes()):
        super().__init__()
        self.train, self.sizes = train, sizes

    def _transform(self, dataset: DataFrame) -> DataFrame:
        key = self.getOrDefault("keyCol")
        found = knn_regress(self.train, dataset, key, self.getLabelCol(), self.getOrDefault("k"), self.sizes)
        return dataset.join(found.select(key, F.col("estimate").alias(self.getPredictionCol())), key, "left")


def validate_discriminant(df: DataFrame, label: str, key: str, folds: int = 10, seed: int = 100) -> DataFrame:
    """(setting, accuracy, accuracy_sd, is_best) of the discriminant over class-balanced folds."""
    rows = labelled(df, label)
    classes = class_labels(rows, label)
    place = F.array_position(F.array(*map(F.lit, classes)), F.col(label).cast("string")) - 1
    folded = materialise(stratified_folds(rows, label, key, folds, seed).withColumn("y", place.cast("double")))
    judge = MulticlassClassificationEvaluator(labelCol="y", predictionCol="prediction", metricName="accuracy")
    tuned = CrossValidator(estimator=Discriminant(), estimatorParamMaps=[{}], evaluator=judge, numFolds=folds, foldCol="fold").fit(folded)
    return tuning_report(tuned, ["discriminant"], df.sparkSession)


def validate_neighbours(df: DataFrame, target: str, stratum: str, key: str, ks: tuple[int, ...] = (9,), folds: int = 10,
                        seed: int = 100, parallelism: int = 2) -> DataFrame:
    """(setting, rmse, rmse_sd, is_best) of nearest-neighbour regression per k, over folds balanced by the stratum."""
    folded = materialise(stratified_folds(labelled(df, target), stratum, key, folds, seed).withColumn(target, F.col(target).cast("double")))
    model = NearestNeighbours(key, target)
    judge = RegressionEvaluator(labelCol=target, predictionCol="prediction", metricName="rmse")
    tuned = CrossValidator(estimator=model, estimatorParamMaps=[{model.k: k} for k in ks], evaluator=judge, numFolds=folds,
                           foldCol="fold", parallelism=parallelism).fit(folded)
    least = tuned.avgMetrics.index(min(tuned.avgMetrics))
    rows = [(f"k={k}", float(m), float(s), i == least) for i, (k, m, s) in enumerate(zip(ks, tuned.avgMetrics, tuned.stdMetrics))]
    return df.sparkSession.createDataFrame(rows, "setting string, rmse double, rmse_sd double, is_best boolean")
