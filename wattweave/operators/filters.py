"""Row selection. Comparisons with literals reach the Parquet scan."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattweave.functions.labels import meter_group

ELECTRICITY = 0


def of_meter(df: DataFrame, *meters: int) -> DataFrame:
    """Rows of one meter code, or of any of several."""
    codes = list(meters) or [ELECTRICITY]
    return df.where(F.col("meter") == codes[0]) if len(codes) == 1 else df.where(F.col("meter").isin(codes))


def where_all(df: DataFrame, *tests: Column) -> DataFrame:
    for test in tests:
        df = df.where(test)
    return df


def at_least(df: DataFrame, column: str, threshold: float) -> DataFrame:
    return df.where(F.col(column) >= threshold)


def missing_rows(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def complete_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.dropna(how="any", subset=columns)


def members_of(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in ``ids``."""
    return df.join(ids.select(key), key, "left_semi")


def not_members_of(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key does not occur in ``ids``; with an empty list every row stays."""
    return df.join(ids.select(key), key, "left_anti")


def in_month(df: DataFrame, month: int, ts: str = "timestamp", year: int | None = None) -> DataFrame:
    """Rows of one calendar month. With a year the test is a range, which prunes row groups at the scan."""
    if year is None:
        return df.where(F.month(ts) == month)
    begin = dt.datetime(year, month, 1)
    end = dt.datetime(year + month // 12, month % 12 + 1, 1)
    return df.where((F.col(ts) >= F.lit(begin).cast("timestamp_ntz")) & (F.col(ts) < F.lit(end).cast("timestamp_ntz")))


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in a stated order."""
    return df.orderBy(*order).limit(n)


def without_site_start(df: DataFrame, cutoff: dt.datetime, site: int = 0, ts: str = "timestamp") -> DataFrame:
    """Drop the readings of one site before a cutoff; rows with an unknown site stay."""
    early = F.col("site_id").eqNullSafe(site) & (F.col(ts) < F.lit(cutoff).cast("timestamp_ntz"))
    return df.where(~F.coalesce(early, F.lit(False)))


def with_meter_group(df: DataFrame) -> DataFrame:
    """Label every row electricity, water or steam; filter on the label instead of keeping three tables."""
    return df.withColumn("meter_group", meter_group("meter"))
