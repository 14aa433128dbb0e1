"""Date parts and the anchor week that turns (weekday, hour) into a plottable timestamp."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ANCHOR_YEAR, ANCHOR_MONTH = 2020, 11  # 2020-11-01 is a Sunday


def weekday(ts) -> Column:
    """1 = Sunday … 7 = Saturday."""
    return F.dayofweek(ts)


def weekday_label(ts) -> Column:
    """Sun … Sat; order by ``weekday``."""
    return F.date_format(ts, "E")


def hour_of(ts) -> Column:
    return F.hour(ts)


def month_of(ts) -> Column:
    return F.month(ts)


def to_hour(ts) -> Column:
    """Start of the hour, kept free of a time zone."""
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def date_of_text(text) -> Column:
    """Date from 'yyyy-MM-dd HH:mm:ss' text: drop everything after the first blank."""
    return F.to_date(F.regexp_replace(text, " .*$", ""))


def timestamp_of_text(text) -> Column:
    return F.to_timestamp_ntz(text, F.lit("yyyy-MM-dd HH:mm:ss"))


def hour_of_text(text) -> Column:
    """Characters 12-13 of the timestamp text as a number."""
    return F.substring(text, 12, 2).cast("int")


def week_anchor(day, hour) -> Column:
    """Weekday and hour placed in the anchor week."""
    zero = F.lit(0)
    return F.make_timestamp_ntz(F.lit(ANCHOR_YEAR), F.lit(ANCHOR_MONTH), F.col(day), F.col(hour), zero, zero)


def month_anchor(month, day, hour) -> Column:
    """Month, weekday and hour placed in the first week of that month of the anchor year."""
    zero = F.lit(0)
    return F.make_timestamp_ntz(F.lit(ANCHOR_YEAR), F.col(month), F.col(day), F.col(hour), zero, zero)


def slot_label(day, hour) -> Column:
    """Text of the anchor timestamp; used as the wide column name of a weekly slot."""
    return F.concat(F.lit(f"{ANCHOR_YEAR}-{ANCHOR_MONTH}-0"), F.col(day).cast("string"), F.lit(" "),
                    F.lpad(F.col(hour).cast("string"), 2, "0"), F.lit(":00:00"))


def week_slots() -> list[str]:
    """The 168 slot labels in time order."""
    return [f"{ANCHOR_YEAR}-{ANCHOR_MONTH}-0{day} {hour:02d}:00:00" for day in range(1, 8) for hour in range(24)]
