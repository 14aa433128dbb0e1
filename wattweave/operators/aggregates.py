"""Grouped means, profiles, counts and null censuses.

Means over a building attribute are taken in two steps: readings are first reduced to sums per
building, meter and time slot (combined before the shuffle, so a building that holds a third of all rows
sends at most one row per slot and task), and only those cells are joined to the metadata.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattweave.functions.dates import month_anchor, month_of, week_anchor
from wattweave.functions.stats import mean_of_parts, mean_parts, mean_strict, sd_sample
from wattweave.operators.joins import with_buildings
from wattweave.operators.projections import with_day_hour


def mean_by(df: DataFrame, keys: list[str], value: str = "meter_reading", name: str = "avg_meter_reading") -> DataFrame:
    return df.groupBy(*keys).agg(mean_strict(value).alias(name))


def mean_by_of_members(readings: DataFrame, keys: list[str], buildings: DataFrame,
                       name: str = "avg_meter_reading") -> DataFrame:
    """Mean reading by columns of the readings, of the listed buildings: readings are summed before the semi-join."""
    cells = readings.groupBy("building_id", *keys).agg(*mean_parts("meter_reading"))
    return cells.join(buildings, "building_id", "left_semi").groupBy(*keys).agg(mean_of_parts().alias(name))


def mean_by_building_attribute(readings: DataFrame, buildings: DataFrame, keys: list[str], attributes: list[str],
                               name: str = "avg_meter_reading") -> DataFrame:
    """Mean reading by columns of the readings (``keys``) and of the metadata (``attributes``)."""
    cells = readings.groupBy("building_id", *keys).agg(*mean_parts("meter_reading"))
    labelled = with_buildings(cells, buildings.select("building_id", *attributes))
    return labelled.groupBy(*keys, *attributes).agg(mean_of_parts().alias(name))


def weekly_profile(readings: DataFrame, with_sd: bool = True) -> DataFrame:
    """Mean (and sample sd) reading per building, weekday and hour."""
    stats = [mean_strict("meter_reading").alias("avg_meter_reading")]
    if with_sd:
        stats.append(sd_sample("meter_reading").alias("sd_meter_reading"))
    return with_day_hour(readings).groupBy("building_id", "day", "hour").agg(*stats)


def slot_profile(readings: DataFrame, slot: Column) -> DataFrame:
    """Mean and sample sd per building and any time slot: (building_id, slot, avg_meter_reading, sd_meter_reading)."""
    return readings.groupBy("building_id", slot.alias("slot")).agg(
        mean_strict("meter_reading").alias("avg_meter_reading"), sd_sample("meter_reading").alias("sd_meter_reading"))


def usage_curve(readings: DataFrame, buildings: DataFrame, attributes: list[str] = ["primary_use"]) -> DataFrame:
    """Mean reading per meter, building attribute, weekday and hour, for all meters in one pass."""
    curve = mean_by_building_attribute(with_day_hour(readings), buildings, ["meter", "day", "hour"], attributes)
    return curve.withColumn("date", week_anchor("day", "hour"))


def monthly_usage_curve(readings: DataFrame, buildings: DataFrame, use: str) -> DataFrame:
    """Mean reading per month, weekday and hour over the buildings of one primary use."""
    of_use = buildings.where(F.col("primary_use") == use).select("building_id")
    cells = (with_day_hour(readings).withColumn("month", month_of("timestamp"))
             .groupBy("building_id", "month", "day", "hour").agg(*mean_parts("meter_reading")))
    curve = (cells.join(of_use, "building_id", "left_semi")
             .groupBy("month", "day", "hour").agg(mean_of_parts().alias("avg_meter_reading")))
    return curve.withColumn("date", month_anchor("month", "day", "hour"))


def weather_means(weather: DataFrame) -> DataFrame:
    """Mean temperature, cloud cover, precipitation and wind speed per site, in one aggregate."""
    return weather.groupBy("site_id").agg(
        mean_strict("air_temperature").alias("avg_tem"),
        mean_strict("cloud_coverage").alias("avg_cloud"),
        mean_strict("precip_depth_1_hr").alias("avg_precip"),
        mean_strict("wind_speed").alias("avg_wind"))


def level_counts(df: DataFrame, level: str) -> DataFrame:
    return df.groupBy(level).agg(F.count(F.lit(1)).alias("n"))


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls per column as (column, nulls): one pass over the table, one output row per column."""
    census = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return census.unpivot([], [f"`{c}`" for c in df.columns], "column", "nulls")


def total_nulls(df: DataFrame) -> DataFrame:
    return null_counts(df).agg(F.sum("nulls").alias("nulls"))


def mean_of_all(df: DataFrame, key: str, complete_only: bool = False) -> DataFrame:
    """Mean of every other column per group; with ``complete_only``, over rows without a null."""
    rows = df.dropna(how="any") if complete_only else df
    pick: list[Column] = [(F.avg(f"`{c}`") if complete_only else mean_strict(F.col(f"`{c}`"))).alias(c)
                          for c in df.columns if c != key]
    return rows.groupBy(key).agg(*pick)


def two_way_table(df: DataFrame, actual: str, predicted: str, levels: list) -> DataFrame:
    """Counts of actual (rows) by predicted (one column per level); zero where a pair does not occur."""
    table = df.groupBy(actual).pivot(predicted, levels).agg(F.count(F.lit(1)))
    return table.select(actual, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(str(v)) for v in levels])


def mode_of(df: DataFrame, column: str) -> DataFrame:
    """The most frequent non-null value; the smallest of several equally frequent ones."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by(F.struct(column, "n"), F.struct("n", -F.col(column)))
    return counts.agg(best.alias("best")).select(F.col("best")[column].alias(column), F.col("best")["n"].alias("n"))


def size_of(df: DataFrame, *tests: Column) -> DataFrame:
    """Rows, columns and the number of rows for which all tests hold."""
    hit = reduce(lambda a, b: a & b, tests, F.lit(True))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_columns"),
                  F.count_if(hit).alias("n_true"))
