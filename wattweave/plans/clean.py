"""Clean and impute: enrich, count nulls, fill building attributes from similar buildings, smooth the weather."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from wattweave.operators.aggregates import null_counts
from wattweave.operators.impute import fill_buildings, fill_weather
from wattweave.operators.joins import with_buildings
from wattweave.operators.knn import Sizes
from wattweave.plans.profiles import WEEKLY, Slots, building_slots


@dataclass(frozen=True)
class Cleaned:
    nulls: DataFrame
    buildings: DataFrame
    weather: DataFrame


def null_census(readings: DataFrame, buildings: DataFrame) -> DataFrame:
    """Nulls per column of the readings with their buildings."""
    return null_counts(with_buildings(readings, buildings))


def clean_and_impute(readings: DataFrame, buildings: DataFrame, weather: DataFrame, slots: Slots = WEEKLY, k: int = 9,
                     sizes: Sizes = Sizes()) -> Cleaned:
    profile = building_slots(readings, slots, with_sd=False)
    return Cleaned(
        nulls=null_census(readings, buildings),
        buildings=fill_buildings(profile, buildings, k, sizes),
        weather=fill_weather(weather))
