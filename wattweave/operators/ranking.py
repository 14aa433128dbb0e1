"""Reproducible splits and folds by hashed key.

An exact rank inside a class needs no sort of the class: rows fall into buckets by the first digits of their
hash, bucket counts give each bucket its offset, and only rows of one bucket are ranked together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 3  # hex digits per bucket: 4,096 buckets per class


def key_hash(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def with_class_rank(df: DataFrame, stratum: str, key: str, seed: int, digits: int = DIGITS) -> DataFrame:
    """Add class_rank (1-based, by hash) and class_size. Keys are expected to be unique."""
    hashed = (df.withColumn("_hash", key_hash(key, seed))
              .withColumn("_bucket", F.substring("_hash", 1, digits)))
    counts = hashed.groupBy(F.col(stratum).alias("_stratum"), F.col("_bucket").alias("_slot")).agg(
        F.count(F.lit(1)).alias("_n"))
    of_class = Window.partitionBy("_stratum")
    before = of_class.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_stratum", "_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
                            F.sum("_n").over(of_class).alias("class_size"))
    within = Window.partitionBy(stratum, "_bucket").orderBy("_hash", key)
    ranked = hashed.withColumn("_row", F.row_number().over(within))
    match = F.col(stratum).eqNullSafe(F.col("_stratum")) & (F.col("_bucket") == F.col("_slot"))
    return (ranked.join(offsets, match)
            .withColumn("class_rank", F.col("_offset") + F.col("_row"))
            .drop("_hash", "_bucket", "_stratum", "_slot", "_offset", "_row"))


def stratified_split(df: DataFrame, stratum: str, key: str, share: float = 0.7, seed: int = 356) -> DataFrame:
    """Mark ceil(share · n) rows of every class as training rows: adds boolean is_train."""
    ranked = with_class_rank(df, stratum, key, seed)
    cut = F.ceil(F.col("class_size") * F.lit(share))
    return ranked.withColumn("is_train", F.col("class_rank") <= cut).drop("class_rank", "class_size")


def random_split(df: DataFrame, key: str, share: float = 0.8, seed: int = 1) -> DataFrame:
    """Mark about ``share`` of the rows as training rows by hash threshold: no shuffle, the same on every run."""
    top = math.floor(share * 16 ** 8)
    return df.withColumn("is_train", F.conv(F.substring(key_hash(key, seed), 1, 8), 16, 10).cast("long") < top)


def stratified_folds(df: DataFrame, stratum: str, key: str, folds: int = 10, seed: int = 100) -> DataFrame:
    """Add fold (0 … folds - 1) so that every class is spread evenly."""
    ranked = with_class_rank(df, stratum, key, seed)
    return ranked.withColumn("fold", ((F.col("class_rank") - 1) % folds).cast("int")).drop("class_rank", "class_size")
