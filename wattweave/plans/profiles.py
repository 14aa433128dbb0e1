"""Profile features shared by the jobs: readings are scanned and aggregated once, then kept as one row per building."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattweave.functions.dates import hour_of, week_slots, weekday
from wattweave.functions.labels import collapse_uses, time_of_day
from wattweave.functions.vectors import is_complete, row_zscore
from wattweave.operators.aggregates import slot_profile
from wattweave.operators.filters import ELECTRICITY, of_meter
from wattweave.operators.reshape import slot_number, to_dense


@dataclass(frozen=True)
class Slots:
    """The number of a reading's time slot, from 0, and the names of all slots."""

    number: Callable[[], Column]
    names: list[str]


PARTS_OF_DAY = ["Morning", "Afternoon", "Evening", "Night"]
WEEKLY = Slots(lambda: slot_number(weekday("timestamp"), hour_of("timestamp")), week_slots())
TIME_OF_DAY = Slots(lambda: F.array_position(F.array(*map(F.lit, PARTS_OF_DAY)), time_of_day(hour_of("timestamp"))).cast("int") - 1, PARTS_OF_DAY)


def building_slots(readings: DataFrame, slots: Slots = WEEKLY, with_sd: bool = True,
                   meter: int = ELECTRICITY) -> DataFrame:
    """(building_id, features): all slot means, then all slot deviations."""
    profile = slot_profile(of_meter(readings, meter), slots.number())
    values = ["avg_meter_reading", "sd_meter_reading"] if with_sd else ["avg_meter_reading"]
    return to_dense(profile, "building_id", "slot", values, len(slots.names))


def feature_frame(slot_rows: DataFrame, buildings: DataFrame, scale_rows: bool = False, attributes: bool = True,
                  uses: list[str] | None = None) -> DataFrame:
    """(building_id, use, features) for complete rows: profile, optionally scaled per row, and building attributes."""
    use = collapse_uses("primary_use") if uses is None else collapse_uses("primary_use", uses)
    rows = slot_rows.join(buildings, "building_id", "left")
    profile = row_zscore("features") if scale_rows else F.col("features")
    extra = F.array(*[F.col(c).cast("double") for c in ("square_feet", "year_built", "floor_count")])
    features = F.concat(profile, extra) if attributes else profile
    return (rows.select("building_id", use.alias("use"), features.alias("features"))
            .where(is_complete("features") & F.col("use").isNotNull()))
