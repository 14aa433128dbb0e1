"""Column selection, derivation, renaming and binding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattweave.functions import dates


def keep_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names)


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def slice_columns(df: DataFrame, start: int = 0, stop: int | None = None) -> DataFrame:
    """Columns at positions [start, stop); negative positions count from the end."""
    return df.select(*[f"`{name}`" for name in df.columns[start:stop]])


def rename_all(df: DataFrame, names: list[str]) -> DataFrame:
    return df.toDF(*names)


def bind_columns(left: DataFrame, right: DataFrame, key: str | list[str]) -> DataFrame:
    """Put the columns of two frames side by side, matched on their row key."""
    return left.join(right, key)


def derive(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.withColumns(columns)


def with_day_hour(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Add weekday (1 = Sunday) and hour."""
    return df.withColumns({"day": dates.weekday(ts), "hour": dates.hour_of(ts)})


def with_date_parts(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Add date, month, weekday label and hour of the timestamp."""
    return df.withColumns({
        "timestamp_date": F.to_date(ts),
        "timestamp_month": dates.month_of(ts),
        "timestamp_day": dates.weekday_label(ts),
        "time_hour": dates.hour_of(ts),
    })
