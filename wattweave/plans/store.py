"""Weekly profiles kept as mergeable moments: new readings add partitions, old readings are not read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattweave.operators.projections import with_day_hour

MOMENTS = ("period date, meter int, building_id long, day int, hour int, n long, n_rows long, mean double, spread double")


def moments(readings: DataFrame, period: str = "month") -> DataFrame:
    """Per period, meter, building, weekday and hour: rows, values, their mean and the sum of squares around it."""
    start = F.to_date(F.date_trunc(period, "timestamp"))
    return with_day_hour(readings.withColumn("period", start)).groupBy("period", "meter", "building_id", "day", "hour").agg(
        F.count("meter_reading").alias("n"), F.count(F.lit(1)).alias("n_rows"), F.avg("meter_reading").alias("mean"),
        (F.var_pop("meter_reading") * F.count("meter_reading")).alias("spread"))


def update_store(readings: DataFrame, path: str, period: str = "month") -> None:
    """Write the moments of the periods that the readings cover, in place of what the store has of these periods. A
    period is written whole: give all its readings."""
    found = moments(readings, period)
    found.repartition("period").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MOMENTS).parquet(path)


def stored_profile(store: DataFrame, meter: int) -> DataFrame:
    """(building_id, day, hour, avg_meter_reading, sd_meter_reading) over all periods. The mean and the deviation are as in
    weekly_profile(): a null reading makes the mean null, a single value has no deviation."""
    filled = F.when(F.col("n") > 0, F.struct("n", "mean", "spread"))
    merged = store.where(F.col("meter") == meter).groupBy("building_id", "day", "hour").agg(
        F.sum("n").alias("n"), F.sum("n_rows").alias("n_rows"), F.sum(F.col("n") * F.col("mean")).alias("total"),
        F.collect_list(filled).alias("parts"))
    merged = merged.withColumn("mean", F.try_divide("total", F.col("n")))
    spread = F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["spread"] + x["n"] * (x["mean"] - F.col("mean")) * (x["mean"] - F.col("mean")))
    return merged.select("building_id", "day", "hour", F.when(F.col("n") == F.col("n_rows"), F.col("mean")).alias("avg_meter_reading"),
                         F.when(F.col("n") > 1, F.sqrt(spread / (F.col("n") - 1))).alias("sd_meter_reading"))
