"""Filling of missing values."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattweave.catalog.base import big, qstamp, query, r6, stamp
from wattweave.operators import impute
from wattweave.operators.kalman import fill_by_smoothing
from wattweave.plans.profiles import TIME_OF_DAY, building_slots
from wattweave.sources.schemas import WEATHER_MEASURES

NAMES = TIME_OF_DAY.names


def neighbours_sql(target: str) -> str:
    """Brute force: every unknown row against every known row, on centred and scaled predictors."""
    features = [f"f{i}" for i in range(len(NAMES))] + ["site_id", "square_feet"]
    slots = ", ".join(f"avg(CASE WHEN slot = '{s}' THEN meter_reading END) AS f{i}" for i, s in enumerate(NAMES))
    whole = " AND ".join(f"{f} IS NOT NULL" for f in features)
    stats = ", ".join(f"avg({f}) AS m_{f}, stddev_samp({f}) AS s_{f}" for f in features)
    gap = " + ".join(f"power((u.{f} - k.{f}) / s_{f}, 2)" for f in features)
    return f"""
, tod AS (SELECT building_id, meter_reading, CASE WHEN hour BETWEEN 5 AND 11 THEN 'Morning' WHEN hour BETWEEN 12 AND 16 THEN 'Afternoon'
               WHEN hour BETWEEN 17 AND 20 THEN 'Evening' ELSE 'Night' END AS slot FROM readings WHERE meter = 0),
wide AS (SELECT building_id, {slots} FROM tod GROUP BY 1),
frame AS (SELECT * FROM wide JOIN buildings USING (building_id)),
known AS (SELECT * FROM frame WHERE {target} IS NOT NULL AND {whole}),
unknown AS (SELECT * FROM frame WHERE {target} IS NULL AND {whole}),
stats AS (SELECT {stats} FROM known),
ranked AS (SELECT u.building_id, k.{target} AS y, rank() OVER (PARTITION BY u.building_id ORDER BY {gap}) AS r
           FROM unknown u, known k, stats),
estimates AS (SELECT building_id, CAST(round_even(avg(y), 0) AS BIGINT) AS y FROM ranked WHERE r <= 9 GROUP BY 1)
SELECT f.building_id, CAST(coalesce(f.{target}, e.y) AS BIGINT) AS {target}
FROM frame f LEFT JOIN estimates e ON e.building_id = f.building_id
"""


def filled(w, target):
    frame = impute.with_predictors(building_slots(w.readings, TIME_OF_DAY, with_sd=False), w.buildings)
    return impute.fill_by_neighbours(frame, target).select("building_id", big(target).alias(target))


@query("i01_neighbours_floor_count", neighbours_sql("floor_count"))
def neighbours_floor_count(w):
    return filled(w, "floor_count")


@query("i02_neighbours_year_built", neighbours_sql("year_built"))
def neighbours_year_built(w):
    return filled(w, "year_built")


@query("i03_smoothed_weather")
def smoothed_weather(w):
    rows = fill_by_smoothing(w.weather, impute.SMOOTHED)
    return rows.select(big("site_id").alias("site_id"), stamp("timestamp").alias("ts"),
                       *[r6(m).alias(m) for m in WEATHER_MEASURES])


@query("i04_mode_precipitation", f"""
, best AS (SELECT precip_depth_1_hr AS mode FROM weather WHERE precip_depth_1_hr IS NOT NULL
           GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT CAST(site_id AS BIGINT) AS site_id, {qstamp('"timestamp"')} AS ts, coalesce(precip_depth_1_hr, mode) AS precip_depth_1_hr
FROM weather, best
""")
def mode_precipitation(w):
    rows = impute.fill_by_mode(w.weather, "precip_depth_1_hr")
    return rows.select(big("site_id").alias("site_id"), stamp("timestamp").alias("ts"), F.col("precip_depth_1_hr"))
