"""Registration of queries and the SQL text shared by their counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattweave.sources.warehouse import Warehouse

RUNS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Means of two-digit values often end exactly between two rounded results; the offset moves them off that edge.
NUDGE = "3.14159e-8"

VIEWS = """
WITH readings AS (
  SELECT user_id AS building_id,
         CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS meter,
         ts AS "timestamp", value AS meter_reading,
         extract(dow FROM ts) + 1 AS day, extract(hour FROM ts) AS hour
  FROM events),
buildings AS (
  SELECT c_custkey AS building_id, c_nationkey AS site_id, c_mktsegment AS primary_use, c_acctbal AS square_feet,
         CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 1900 + c_custkey % 120 END AS year_built,
         CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 1 + c_custkey % 30 END AS floor_count
  FROM customer),
weather AS (
  SELECT CAST(user_id % 16 AS INTEGER) AS site_id, date_trunc('hour', ts) AS "timestamp",
         avg(CASE WHEN event_type = 'view' THEN value END) AS air_temperature,
         avg(CASE WHEN event_type = 'click' THEN value END) AS cloud_coverage,
         avg(CASE WHEN event_type = 'purchase' THEN value END) AS dew_temperature,
         CAST(nullif(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END), 0) AS DOUBLE) AS precip_depth_1_hr,
         avg(CASE WHEN event_type = 'signup' THEN value END) AS sea_level_pressure,
         avg(CASE WHEN event_type = 'error' THEN value END) AS wind_direction,
         max(value) AS wind_speed
  FROM events GROUP BY 1, 2)
"""


def query(name: str, sql: str | None = None, views: bool = True):
    """Register ``fn(warehouse) -> DataFrame``. With ``views`` the SQL may use readings, buildings and weather, and
    may start with a comma to add views of its own."""
    def register(fn: Callable[[Warehouse], DataFrame]):
        if name in RUNS:
            raise ValueError(f"{name} is registered twice")
        RUNS[name] = lambda spark, folder: fn(Warehouse(spark, folder))
        if sql:
            ORACLES[name] = (VIEWS + sql if views else sql).strip()
        return fn

    return register


def r6(value: Column | str) -> Column:
    """Six decimals, for comparison across engines."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value + F.lit(float(NUDGE)), 6)


def q6(expression: str) -> str:
    return f"round(({expression}) + {NUDGE}, 6)"


def big(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return value.cast("bigint")


def stamp(value: Column | str) -> Column:
    return F.date_format(value, "yyyy-MM-dd HH:mm:ss")


def qstamp(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S')"


def strict(expression: str) -> str:
    """SQL mean that is null if one input is null."""
    return f"CASE WHEN count({expression}) = count(*) THEN avg({expression}) END"
