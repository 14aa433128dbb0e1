"""Projections, filters and joins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from wattweave.catalog.base import big, q6, qstamp, query, r6, stamp
from wattweave.catalog.scans import shown_readings
from wattweave.operators import filters, joins, order_stats, projections
from wattweave.operators.joins import with_buildings
from wattweave.sources.schemas import WEATHER_MEASURES

SHOWN = f"""building_id, CAST(meter AS BIGINT) AS meter, {qstamp('"timestamp"')} AS ts, {q6('meter_reading')} AS meter_reading"""


@query("p01_keep_columns", "SELECT building_id, primary_use, square_feet FROM buildings")
def keep_columns(w):
    return projections.keep_columns(w.buildings, "building_id", "primary_use", "square_feet")


@query("p02_drop_columns", "SELECT building_id, primary_use, square_feet FROM buildings")
def drop_columns(w):
    return projections.drop_columns(w.buildings, "site_id", "year_built", "floor_count")


@query("p03_slice_columns", "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name FROM customer", views=False)
def slice_columns(w):
    return projections.slice_columns(w.table("customer"), 0, -3)


@query("p04_derive_columns", """
SELECT building_id, strftime("timestamp", '%Y-%m-%d') AS timestamp_date,
       CAST(extract(month FROM "timestamp") AS BIGINT) AS timestamp_month,
       strftime("timestamp", '%a') AS timestamp_day, CAST(hour AS BIGINT) AS time_hour
FROM readings
""")
def derive_columns(w):
    parts = projections.with_date_parts(w.readings)
    return parts.select("building_id", F.col("timestamp_date").cast("string").alias("timestamp_date"),
                        big("timestamp_month").alias("timestamp_month"), "timestamp_day",
                        big("time_hour").alias("time_hour"))


@query("p05_rename_all", """
SELECT CAST(s_suppkey AS BIGINT) AS id, s_name AS name, CAST(s_nationkey AS BIGINT) AS site, s_acctbal AS area FROM supplier
""", views=False)
def rename_all(w):
    return projections.rename_all(w.table("supplier"), ["id", "name", "site", "area"]).withColumn("site", big("site"))


@query("p06_bind_columns", """
SELECT b.building_id, b.primary_use, c.c_name FROM buildings b JOIN customer c ON c.c_custkey = b.building_id
""")
def bind_columns(w):
    names = w.table("customer").select(F.col("c_custkey").alias("building_id"), "c_name")
    return projections.bind_columns(w.buildings.select("building_id", "primary_use"), names, "building_id")


@query("p07_equality_filter", f"SELECT {SHOWN} FROM readings WHERE meter = 0")
def equality_filter(w):
    return shown_readings(filters.of_meter(w.readings, 0))


@query("p08_conjunctive_filter", f"""
SELECT {SHOWN} FROM readings JOIN buildings USING (building_id) WHERE meter = 0 AND primary_use = 'BUILDING'
""")
def conjunctive_filter(w):
    rows = with_buildings(w.readings, w.buildings)
    return shown_readings(filters.where_all(rows, F.col("meter") == 0, F.col("primary_use") == "BUILDING"))


@query("p09_disjunctive_filter", f"SELECT {SHOWN} FROM readings WHERE meter = 1 OR meter = 3")
def disjunctive_filter(w):
    return shown_readings(filters.of_meter(w.readings, 1, 3))


@query("p10_threshold_filter", f"SELECT {SHOWN} FROM readings WHERE meter_reading >= 50")
def threshold_filter(w):
    return shown_readings(filters.at_least(w.readings, "meter_reading", 50))


@query("p11_null_filter", "SELECT building_id, primary_use FROM buildings WHERE floor_count IS NULL")
def null_filter(w):
    return filters.missing_rows(w.buildings, "floor_count").select("building_id", "primary_use")


@query("p12_complete_cases", """
SELECT building_id, CAST(year_built AS BIGINT) AS year_built, CAST(floor_count AS BIGINT) AS floor_count
FROM buildings WHERE year_built IS NOT NULL AND floor_count IS NOT NULL AND square_feet IS NOT NULL
""")
def complete_cases(w):
    return filters.complete_rows(w.buildings).select(
        "building_id", big("year_built").alias("year_built"), big("floor_count").alias("floor_count"))


def of_building_use(w):
    return w.buildings.where(F.col("primary_use") == "BUILDING").select("building_id")


@query("p13_membership", f"""
SELECT {SHOWN} FROM readings WHERE building_id IN (SELECT building_id FROM buildings WHERE primary_use = 'BUILDING')
""")
def membership(w):
    return shown_readings(filters.members_of(w.readings, of_building_use(w), "building_id"))


FENCES = """
, ranked AS (
  SELECT meter_reading AS x, row_number() OVER (ORDER BY meter_reading) AS r, count(*) OVER () AS n
  FROM readings WHERE meter = 0),
depth AS (SELECT *, floor((n + 3) / 2.0) / 2 AS m FROM ranked),
hinges AS (
  SELECT avg(CASE WHEN r = floor(m) THEN x END) / 2 + avg(CASE WHEN r = ceil(m) THEN x END) / 2 AS lower_hinge,
         avg(CASE WHEN r = n + 1 - floor(m) THEN x END) / 2 + avg(CASE WHEN r = n + 1 - ceil(m) THEN x END) / 2 AS upper_hinge
  FROM depth),
fences AS (
  SELECT lower_hinge, upper_hinge, lower_hinge - 1.5 * (upper_hinge - lower_hinge) AS low,
         upper_hinge + 1.5 * (upper_hinge - lower_hinge) AS high FROM hinges)
"""


@query("p14_without_outliers", FENCES + f"""
SELECT {SHOWN} FROM readings, fences WHERE meter = 0 AND (meter_reading IS NULL OR meter_reading BETWEEN low AND high)
""")
def without_outliers(w):
    return shown_readings(order_stats.without_outliers(filters.of_meter(w.readings, 0), "meter_reading"))


@query("p14_anti_membership", f"""
SELECT {SHOWN} FROM readings
WHERE building_id NOT IN (SELECT building_id FROM buildings WHERE primary_use = 'BUILDING')
""")
def anti_membership(w):
    return shown_readings(filters.not_members_of(w.readings, of_building_use(w), "building_id"))


@query("p15_month_filter", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity FROM lineitem WHERE extract(month FROM l_shipdate) = 2
""", views=False)
def month_filter(w):
    rows = filters.in_month(w.table("lineitem"), 2, "l_shipdate")
    return rows.select("l_orderkey", big("l_linenumber").alias("l_linenumber"), "l_quantity")


@query("p15_month_range_filter", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1998-02-01' AND l_shipdate < TIMESTAMP '1998-03-01'
""", views=False)
def month_range_filter(w):
    rows = filters.in_month(w.table("lineitem"), 2, "l_shipdate", year=1998)
    return rows.select("l_orderkey", big("l_linenumber").alias("l_linenumber"), "l_quantity")


@query("p16_first_rows", """
SELECT event_id, value FROM events ORDER BY event_id LIMIT 10
""", views=False)
def first_rows(w):
    return filters.first_rows(w.table("events").select("event_id", "value"), 10, "event_id")


@query("p17_without_site_start", f"""
SELECT {SHOWN} FROM readings LEFT JOIN buildings USING (building_id)
WHERE NOT coalesce(site_id = 0 AND "timestamp" < TIMESTAMP '2024-01-15', false)
""")
def without_site_start(w):
    rows = with_buildings(w.readings, w.buildings)
    return shown_readings(filters.without_site_start(rows, dt.datetime(2024, 1, 15)))


@query("p18_meter_groups", """
SELECT CASE WHEN meter = 0 THEN 'electricity' WHEN meter IN (1, 3) THEN 'water' WHEN meter = 2 THEN 'steam' END AS meter_group,
       count(*) AS n FROM readings GROUP BY 1
""")
def meter_groups(w):
    return filters.with_meter_group(w.readings).groupBy("meter_group").agg(F.count(F.lit(1)).alias("n"))


@query("j01_readings_buildings", f"""
SELECT {SHOWN}, CAST(site_id AS BIGINT) AS site_id, primary_use FROM readings LEFT JOIN buildings USING (building_id)
""")
def readings_buildings(w):
    rows = joins.with_buildings(w.readings, w.buildings)
    return rows.select("building_id", big("meter").alias("meter"), stamp("timestamp").alias("ts"),
                       r6("meter_reading").alias("meter_reading"), big("site_id").alias("site_id"), "primary_use")


@query("j02_weather", f"""
SELECT r.building_id, {qstamp('r."timestamp"')} AS ts, {q6('r.meter_reading')} AS meter_reading,
       CAST(b.site_id AS BIGINT) AS site_id, {', '.join(f'{q6("w." + m)} AS {m}' for m in WEATHER_MEASURES)}
FROM readings r LEFT JOIN buildings b ON b.building_id = r.building_id
LEFT JOIN weather w ON w.site_id = b.site_id AND w."timestamp" = date_trunc('hour', r."timestamp")
""")
def weather(w):
    rows = joins.with_weather(with_buildings(w.readings, w.buildings.select("building_id", "site_id")), w.weather)
    return rows.select("building_id", stamp("timestamp").alias("ts"), r6("meter_reading").alias("meter_reading"),
                       big("site_id").alias("site_id"), *[r6(m).alias(m) for m in WEATHER_MEASURES])


@query("j02_weather_bucketed", f"""
SELECT r.building_id, {qstamp('r."timestamp"')} AS ts, {q6('r.meter_reading')} AS meter_reading,
       CAST(b.site_id AS BIGINT) AS site_id, {', '.join(f'{q6("w." + m)} AS {m}' for m in WEATHER_MEASURES)}
FROM readings r LEFT JOIN buildings b ON b.building_id = r.building_id
LEFT JOIN weather w ON w.site_id = b.site_id AND w."timestamp" = date_trunc('hour', r."timestamp")
""")
def weather_bucketed(w):
    """Readings and weather are laid out once by site and hour; the join then moves no rows."""
    readings = with_buildings(w.readings, w.buildings.select("building_id", "site_id"))
    rows = joins.with_stored_weather(*joins.store_by_site_hour(readings, w.weather))
    return rows.select("building_id", stamp("timestamp").alias("ts"), r6("meter_reading").alias("meter_reading"),
                       big("site_id").alias("site_id"), *[r6(m).alias(m) for m in WEATHER_MEASURES])


@query("j03_profile_buildings", f"""
, tod AS (SELECT building_id, CASE WHEN hour BETWEEN 5 AND 11 THEN 'Morning' WHEN hour BETWEEN 12 AND 16 THEN 'Afternoon'
                 WHEN hour BETWEEN 17 AND 20 THEN 'Evening' ELSE 'Night' END AS slot, meter_reading
          FROM readings WHERE meter = 0),
wide AS (SELECT building_id, {', '.join(f"avg(CASE WHEN slot = '{s}' THEN meter_reading END) AS s{i}"
                                        for i, s in enumerate(['Morning', 'Afternoon', 'Evening', 'Night']))}
         FROM tod GROUP BY 1)
SELECT w.building_id, {', '.join(f'{q6(f"s{i}")} AS "{s}"' for i, s in enumerate(['Morning', 'Afternoon', 'Evening', 'Night']))},
       primary_use, square_feet
FROM wide w LEFT JOIN buildings b ON b.building_id = w.building_id
""")
def profile_buildings(w):
    from wattweave.plans.profiles import TIME_OF_DAY, building_slots

    slots = building_slots(w.readings, TIME_OF_DAY, with_sd=False)
    wide = slots.select("building_id", *[F.get("features", F.lit(i)).alias(s) for i, s in enumerate(TIME_OF_DAY.names)])
    rows = joins.with_buildings(wide, w.buildings)
    return rows.select("building_id", *[r6(s).alias(s) for s in TIME_OF_DAY.names], "primary_use", "square_feet")


@query("j04_merge_estimates", """
SELECT b.building_id, CAST(coalesce(b.floor_count, e.floor_count) AS BIGINT) AS floor_count
FROM buildings b FULL OUTER JOIN (SELECT building_id, 7 AS floor_count FROM buildings WHERE floor_count IS NULL) e
ON e.building_id = b.building_id
""")
def merge_estimates(w):
    known = w.buildings.select("building_id", "floor_count")
    guesses = filters.missing_rows(known, "floor_count").withColumn("floor_count", F.lit(7))
    merged = joins.merge_estimates(known, guesses, "building_id", "floor_count")
    return merged.select("building_id", big("floor_count").alias("floor_count"))


@query("j05_semi_join", """
SELECT building_id, primary_use FROM buildings WHERE building_id IN (SELECT user_id FROM events WHERE value >= 150)
""")
def semi_join(w):
    high = filters.at_least(w.readings, "meter_reading", 150)
    return filters.members_of(w.buildings.select("building_id", "primary_use"), high, "building_id")


@query("j05_anti_join", """
SELECT building_id, primary_use FROM buildings WHERE building_id NOT IN (SELECT user_id FROM events WHERE value >= 150)
""")
def anti_join(w):
    high = filters.at_least(w.readings, "meter_reading", 150)
    return filters.not_members_of(w.buildings.select("building_id", "primary_use"), high, "building_id")
