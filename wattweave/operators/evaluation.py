"""Scores of predicted against actual classes. Rows are counted per pair of classes first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattweave.functions.stats import if_else


def class_by_threshold(probability, positive: str, negative: str, cut: float = 0.5) -> Column:
    """The positive class where its probability exceeds the cut; null stays null."""
    p = F.col(probability) if isinstance(probability, str) else probability
    return if_else(p > cut, positive, negative)


def accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    hit = (F.col(actual) == F.col(predicted)).cast("double")
    return df.agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Counts per (target, prediction) with sums and overall, row and column percentages."""
    cells = (df.groupBy(F.col(actual).alias("target"), F.col(predicted).alias("prediction"))
             .agg(F.count(F.lit(1)).alias("n")))
    total = Window.partitionBy(F.lit(0))
    summed = cells.withColumns({
        "target_sum": F.sum("n").over(Window.partitionBy("target")),
        "prediction_sum": F.sum("n").over(Window.partitionBy("prediction")),
        "total": F.sum("n").over(total),
    })
    return summed.select(
        "target", "prediction", "n", "target_sum", "prediction_sum", "total",
        (100.0 * F.col("n") / F.col("total")).alias("overall_pct"),
        (100.0 * F.col("n") / F.col("target_sum")).alias("target_pct"),
        (100.0 * F.col("n") / F.col("prediction_sum")).alias("prediction_pct"))


def sensitivity_precision(df: DataFrame, actual: str, predicted: str, positive) -> DataFrame:
    """Share of positives found, share of positive predictions that are right, and accuracy."""
    is_pos, said_pos = F.col(actual) == F.lit(positive), F.col(predicted) == F.lit(positive)
    counts = df.agg(F.count_if(is_pos & said_pos).alias("tp"), F.count_if(is_pos & ~said_pos).alias("fn"),
                    F.count_if(~is_pos & said_pos).alias("fp"), F.count_if(~is_pos & ~said_pos).alias("tn"))

    def ratio(top: Column, bottom: Column) -> Column:
        return top / F.nullif(bottom, F.lit(0))

    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    return counts.select(ratio(tp, tp + fn).alias("sensitivity"), ratio(tp, tp + fp).alias("precision"),
                         ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"))
