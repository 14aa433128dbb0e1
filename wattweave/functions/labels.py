"""Rules that turn raw values into category labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattweave.functions.stats import if_else

# The primary uses that are merged into "Other" before classification.
OTHER_USES = [
    "Other", "Warehouse/storage", "Utility", "Technology/science", "Services", "Retail",
    "Religious worship", "Food sales and service", "Manufacturing/industrial", "Healthcare", "Parking",
]

# Meter codes by utility.
METER_GROUPS = {"electricity": [0], "water": [1, 3], "steam": [2]}


def collapse_uses(use, members: list[str] = OTHER_USES, into: str = "Other") -> Column:
    use = F.col(use) if isinstance(use, str) else use
    return F.when(use.isin(members), F.lit(into)).otherwise(use)


def use_flag(use, positive: str = "Education", negative: str = "Other") -> Column:
    """Binary label: the named use against everything else; null stays null."""
    use = F.col(use) if isinstance(use, str) else use
    return if_else(use == positive, positive, negative)


def time_of_day(hour) -> Column:
    """5-11 Morning, 12-16 Afternoon, 17-20 Evening, any other hour Night; null stays null."""
    hour = F.col(hour) if isinstance(hour, str) else hour
    return (F.when(hour.isNull(), F.lit(None).cast("string"))
            .when(hour.between(5, 11), "Morning")
            .when(hour.between(12, 16), "Afternoon")
            .when(hour.between(17, 20), "Evening")
            .otherwise("Night"))


def meter_group(meter) -> Column:
    meter = F.col(meter) if isinstance(meter, str) else meter
    rule = F.lit(None).cast("string")
    for name, codes in METER_GROUPS.items():
        rule = F.when(meter.isin(codes), name).otherwise(rule)
    return rule
