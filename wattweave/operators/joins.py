"""Equi-joins. None carries a broadcast hint: Spark compares the measured size with its threshold and
otherwise sorts and merges, splitting skewed partitions at run time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattweave.functions.dates import to_hour
from wattweave.sources.shared import new_path
from wattweave.sources.tables import write_bucketed


def with_buildings(readings: DataFrame, buildings: DataFrame) -> DataFrame:
    """Readings (or any rows with building_id) with the metadata of their building."""
    return readings.join(buildings, "building_id", "left")


def with_weather(rows: DataFrame, weather: DataFrame) -> DataFrame:
    """Rows that carry site_id and timestamp, with the weather of that site and hour."""
    hourly = rows.withColumn("weather_hour", to_hour("timestamp"))
    return hourly.join(weather.withColumnRenamed("timestamp", "weather_hour"), ["site_id", "weather_hour"], "left")


BUCKETS = 32


def store_by_site_hour(rows: DataFrame, weather: DataFrame, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """Rows and weather as tables of the shared folder, bucketed and sorted by site_id and weather_hour."""
    keys, spark = ["site_id", "weather_hour"], rows.sparkSession
    frames = {"readings": rows.withColumn("weather_hour", to_hour("timestamp")), "weather": weather.withColumnRenamed("timestamp", "weather_hour")}
    out = []
    for name, df in frames.items():
        path = new_path(spark, f"{name}_by_site_hour")
        out.append(write_bucketed(df, path.rsplit("/", 1)[-1].replace("-", "_"), path, keys, buckets))
    return out[0], out[1]


def with_stored_weather(rows: DataFrame, weather: DataFrame) -> DataFrame:
    """The tables of store_by_site_hour() joined bucket by bucket, without an exchange."""
    return rows.join(weather.hint("merge"), ["site_id", "weather_hour"], "left")


def merge_estimates(left: DataFrame, right: DataFrame, key: str, column: str) -> DataFrame:
    """Full outer join on the key; the column takes the left value where there is one, else the right."""
    a, b = left.alias("a"), right.select(key, F.col(column).alias("estimate")).alias("b")
    joined = a.join(b, key, "full")
    return joined.withColumn(column, F.coalesce(F.col(column), F.col("estimate"))).drop("estimate")
