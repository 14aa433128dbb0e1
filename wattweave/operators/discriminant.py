"""Linear discriminant analysis: class means and pooled covariance by aggregation, scores per row in batches."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattweave.operators.knn import matrix


@dataclass(frozen=True)
class DiscriminantModel:
    """score(class) = x · weights + offset; the class with the highest score is predicted."""

    classes: list
    priors: np.ndarray
    means: np.ndarray
    weights: np.ndarray
    offsets: np.ndarray

    def transform(self, df: DataFrame, features: str = "features", prediction: str = "prediction") -> DataFrame:
        """Add the predicted class and the probability of that class."""
        classes, weights, offsets = self.classes, self.weights, self.offsets
        label_type = "string" if isinstance(classes[0], str) else "int"

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    scores = matrix(batch.column(features)) @ weights.T + offsets
                    best = scores.argmax(1)
                    top = scores[np.arange(len(best)), best]
                    share = 1.0 / np.exp(scores - top[:, None]).sum(1)
                    labels = pa.array([classes[i] for i in best], pa.string() if label_type == "string" else pa.int32())
                    yield pa.RecordBatch.from_arrays([*batch.columns, labels, pa.array(share)],
                                                     [*batch.schema.names, prediction, "probability"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        return df.mapInArrow(score, f"{fields}, `{prediction}` {label_type}, probability double")

    def coefficients(self, spark) -> DataFrame:
        """One row per class: prior, offset and the weight per feature."""
        rows = [(str(c), float(p), float(o), [float(x) for x in w])
                for c, p, o, w in zip(self.classes, self.priors, self.offsets, self.weights)]
        return spark.createDataFrame(rows, "class string, prior double, offset double, weights array<double>")


def fit_discriminant(df: DataFrame, label: str, features: str = "features") -> DiscriminantModel:
    """Two passes: class means, then the pooled scatter around them. The p × p system is solved on the driver;
    a pseudo-inverse serves correlated predictors. Rows without a label are not learned from."""
    df = df.where(F.col(label).isNotNull())
    per_class = (df.groupBy(label).agg(Summarizer.metrics("mean", "count").summary(array_to_vector(features)).alias("s"))
                 .orderBy(label).collect())
    classes = [r[label] for r in per_class]
    counts = np.array([r["s"]["count"] for r in per_class], dtype=float)
    means = np.array([r["s"]["mean"].toArray() for r in per_class])
    index = {c: i for i, c in enumerate(classes)}

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((means.shape[1], means.shape[1]))
        for batch in batches:
            if batch.num_rows:
                group = np.array([index[c] for c in batch.column(label).to_pylist()])
                centred = matrix(batch.column(features)) - means[group]
                total += centred.T @ centred
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["row", "sums"])

    parts = df.select(label, features).mapInArrow(scatter, "row int, sums array<double>")
    pooled_rows = parts.groupBy("row").agg(Summarizer.sum(array_to_vector("sums")).alias("sums")).orderBy("row").collect()
    pooled = np.array([r["sums"].toArray() for r in pooled_rows]) / max(1.0, counts.sum() - len(classes))
    weights = means @ np.linalg.pinv(pooled)
    priors = counts / counts.sum()
    offsets = np.array([math.log(p) for p in priors]) - 0.5 * (weights * means).sum(1)
    return DiscriminantModel(classes, priors, means, weights, offsets)
