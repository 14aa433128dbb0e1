"""Filling of missing building attributes and weather measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattweave.functions.stats import round_half_even
from wattweave.functions.vectors import is_complete
from wattweave.operators.aggregates import mode_of
from wattweave.operators.joins import merge_estimates
from wattweave.operators.kalman import CHUNK_ROWS, fill_by_smoothing
from wattweave.operators.knn import Sizes, knn_regress
from wattweave.sources.shared import materialise

SMOOTHED = ["air_temperature", "cloud_coverage", "dew_temperature", "sea_level_pressure", "wind_direction", "wind_speed"]


def with_predictors(slots: DataFrame, buildings: DataFrame, key: str = "building_id") -> DataFrame:
    """Profile arrays with site and floor area appended as the last two features, and the building's attributes."""
    joined = slots.join(buildings, key, "left")
    extra = F.array(F.col("site_id").cast("double"), F.col("square_feet").cast("double"))
    return joined.withColumn("features", F.concat("features", extra))


def neighbour_estimates(frame: DataFrame, target: str, key: str = "building_id", k: int = 9,
                        sizes: Sizes = Sizes()) -> DataFrame:
    """(key, target) for the rows whose target is null: the rounded mean of the k nearest complete rows.

    A row without a complete feature array has no neighbours and gets no estimate.
    """
    scorable = frame.where(is_complete("features"))
    known = scorable.where(F.col(target).isNotNull())
    unknown = scorable.where(F.col(target).isNull())
    estimates = knn_regress(known, unknown, key, target, k, sizes)
    return estimates.select(key, round_half_even("estimate").cast(frame.schema[target].dataType).alias(target))


def fill_by_neighbours(frame: DataFrame, target: str, key: str = "building_id", k: int = 9,
                       sizes: Sizes = Sizes()) -> DataFrame:
    """Replace a null target by its neighbour estimate."""
    return merge_estimates(frame, neighbour_estimates(frame, target, key, k, sizes), key, target)


def fill_buildings(slots: DataFrame, buildings: DataFrame, k: int = 9, sizes: Sizes = Sizes()) -> DataFrame:
    """Buildings with a profile, their floor_count and year_built filled from similar buildings.

    Neither target is a predictor of the other, so both are estimated from the same frame.
    """
    frame = materialise(with_predictors(slots, buildings))
    filled = frame.drop("features")
    for target in ("floor_count", "year_built"):
        filled = merge_estimates(filled, neighbour_estimates(frame, target, k=k, sizes=sizes), "building_id", target)
    return filled.select("building_id", "floor_count", "primary_use", "square_feet", "year_built", "site_id")


def fill_by_mode(df: DataFrame, column: str) -> DataFrame:
    """Replace nulls by the most frequent value of the column."""
    best = mode_of(df, column).first()[column]
    return df if best is None else df.withColumn(column, F.coalesce(column, F.lit(best)))


def fill_weather(weather: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Smooth six measures per site and fill precipitation with its mode."""
    precipitation = fill_by_mode(weather, "precip_depth_1_hr")  # not smoothed, so its mode is that of the raw weather
    return fill_by_smoothing(precipitation, SMOOTHED, chunk_rows=chunk_rows)
