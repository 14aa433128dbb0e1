"""Grouped means, summaries, counts and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattweave.catalog.base import big, q6, qstamp, query, r6, stamp, strict
from wattweave.catalog.relational import FENCES
from wattweave.functions.dates import week_slots
from wattweave.functions.labels import time_of_day
from wattweave.operators import aggregates, filters, order_stats, projections, reshape
from wattweave.plans import store
from wattweave.sources.schemas import WEATHER_MEASURES
from wattweave.sources.shared import new_path

MEAN = q6(strict("meter_reading"))


def electricity(w):
    return filters.of_meter(w.readings, 0)


@query("a01_mean_by_date", f"""
SELECT strftime("timestamp", '%Y-%m-%d') AS timestamp_date, {MEAN} AS avg_meter_reading
FROM readings JOIN buildings USING (building_id) WHERE meter = 0 AND site_id = 0 GROUP BY 1
""")
def mean_by_date(w):
    site = w.buildings.where(F.col("site_id") == 0)
    means = aggregates.mean_by_of_members(projections.with_date_parts(electricity(w)), ["timestamp_date"], site)
    return means.select(F.col("timestamp_date").cast("string").alias("timestamp_date"),
                        r6("avg_meter_reading").alias("avg_meter_reading"))


@query("a01_mean_by_hour", f"""
SELECT CAST(hour AS BIGINT) AS time_hour, {MEAN} AS avg_meter_reading FROM readings WHERE meter = 0 GROUP BY 1
""")
def mean_by_hour(w):
    means = aggregates.mean_by(projections.with_date_parts(electricity(w)), ["time_hour"])
    return means.select(big("time_hour").alias("time_hour"), r6("avg_meter_reading").alias("avg_meter_reading"))


@query("a01_mean_by_weekday", f"""
SELECT strftime("timestamp", '%a') AS timestamp_day, {MEAN} AS avg_meter_reading FROM readings WHERE meter = 0 GROUP BY 1
""")
def mean_by_weekday(w):
    means = aggregates.mean_by(projections.with_date_parts(electricity(w)), ["timestamp_day"])
    return means.select("timestamp_day", r6("avg_meter_reading").alias("avg_meter_reading"))


@query("a01_mean_by_use", f"""
SELECT primary_use, {MEAN} AS avg_meter_reading FROM readings LEFT JOIN buildings USING (building_id) WHERE meter = 0 GROUP BY 1
""")
def mean_by_use(w):
    means = aggregates.mean_by_building_attribute(electricity(w), w.buildings, [], ["primary_use"])
    return means.select("primary_use", r6("avg_meter_reading").alias("avg_meter_reading"))


@query("a02_weekly_mean", f"""
SELECT building_id, CAST(day AS BIGINT) AS day, CAST(hour AS BIGINT) AS hour, {MEAN} AS avg_meter_reading
FROM readings WHERE meter = 0 GROUP BY 1, 2, 3
""")
def weekly_mean(w):
    profile = aggregates.weekly_profile(electricity(w), with_sd=False)
    return profile.select("building_id", big("day").alias("day"), big("hour").alias("hour"),
                          r6("avg_meter_reading").alias("avg_meter_reading"))


@query("a03_weekly_profile", f"""
SELECT building_id, CAST(day AS BIGINT) AS day, CAST(hour AS BIGINT) AS hour, {MEAN} AS avg_meter_reading,
       {q6('stddev_samp(meter_reading)')} AS sd_meter_reading
FROM readings WHERE meter = 0 GROUP BY 1, 2, 3
""")
def weekly_profile(w):
    profile = aggregates.weekly_profile(electricity(w))
    return profile.select("building_id", big("day").alias("day"), big("hour").alias("hour"),
                          r6("avg_meter_reading").alias("avg_meter_reading"),
                          r6("sd_meter_reading").alias("sd_meter_reading"))


@query("a03_stored_profile", f"""
SELECT building_id, CAST(day AS BIGINT) AS day, CAST(hour AS BIGINT) AS hour, {MEAN} AS avg_meter_reading,
       {q6('stddev_samp(meter_reading)')} AS sd_meter_reading
FROM readings WHERE meter = 0 GROUP BY 1, 2, 3
""")
def profile_of_store(w):
    """The store is written for the first weeks and updated with the others, each read once."""
    path, later = new_path(w.spark, "profile-store"), F.col("timestamp") >= F.lit("2024-01-15").cast("timestamp_ntz")
    store.update_store(w.readings.where(~later), path, "week")
    store.update_store(w.readings.where(later), path, "week")
    profile = store.stored_profile(store.read_store(w.spark, path), 0)
    return profile.select("building_id", big("day").alias("day"), big("hour").alias("hour"),
                          r6("avg_meter_reading").alias("avg_meter_reading"), r6("sd_meter_reading").alias("sd_meter_reading"))


@query("a04_usage_curve", f"""
SELECT CAST(meter AS BIGINT) AS meter, primary_use, {qstamp('make_timestamp(2020, 11, day, hour, 0, 0)')} AS date,
       {MEAN} AS avg_meter_reading
FROM readings LEFT JOIN buildings USING (building_id) WHERE meter IN (0, 1, 2, 3) GROUP BY 1, 2, 3
""")
def usage_curve(w):
    curve = aggregates.usage_curve(filters.of_meter(w.readings, 0, 1, 2, 3), w.buildings)
    return curve.select(big("meter").alias("meter"), "primary_use", stamp("date").alias("date"),
                        r6("avg_meter_reading").alias("avg_meter_reading"))


@query("a05_monthly_usage_curve", f"""
SELECT CAST(extract(month FROM "timestamp") AS BIGINT) AS month,
       {qstamp('make_timestamp(2020, extract(month FROM "timestamp"), day, hour, 0, 0)')} AS date, {MEAN} AS avg_meter_reading
FROM readings JOIN buildings USING (building_id) WHERE meter = 0 AND primary_use = 'BUILDING' GROUP BY 1, 2
""")
def monthly_usage_curve(w):
    curve = aggregates.monthly_usage_curve(electricity(w), w.buildings, "BUILDING")
    return curve.select(big("month").alias("month"), stamp("date").alias("date"),
                        r6("avg_meter_reading").alias("avg_meter_reading"))


@query("a06_weather_means", f"""
SELECT CAST(site_id AS BIGINT) AS site_id, {q6(strict('air_temperature'))} AS avg_tem, {q6(strict('cloud_coverage'))} AS avg_cloud,
       {q6(strict('precip_depth_1_hr'))} AS avg_precip, {q6(strict('wind_speed'))} AS avg_wind
FROM weather GROUP BY 1
""")
def weather_means(w):
    means = aggregates.weather_means(w.weather)
    return means.select(big("site_id").alias("site_id"),
                        *[r6(c).alias(c) for c in ("avg_tem", "avg_cloud", "avg_precip", "avg_wind")])


@query("a06_weather_means_complete", f"""
SELECT CAST(site_id AS BIGINT) AS site_id, {', '.join(f"{q6(f'avg(coalesce({c}, 0))')} AS {n}" for c, n in (
    ('air_temperature', 'avg_tem'), ('cloud_coverage', 'avg_cloud'), ('precip_depth_1_hr', 'avg_precip'), ('wind_speed', 'avg_wind')))}
FROM weather GROUP BY 1
""")
def weather_means_complete(w):
    means = aggregates.weather_means(w.weather.fillna(0.0, WEATHER_MEASURES))
    return means.select(big("site_id").alias("site_id"),
                        *[r6(c).alias(c) for c in ("avg_tem", "avg_cloud", "avg_precip", "avg_wind")])


@query("a07_floor_mean_by_site", f"""
SELECT CAST(site_id AS BIGINT) AS site_id, {q6('avg(floor_count)')} AS avg_floor FROM buildings
WHERE floor_count IS NOT NULL GROUP BY 1
""")
def floor_mean_by_site(w):
    known = w.buildings.dropna(subset=["floor_count"])
    means = aggregates.mean_by(known, ["site_id"], "floor_count", "avg_floor")
    return means.select(big("site_id").alias("site_id"), r6("avg_floor").alias("avg_floor"))


def summary_sql(column: str, source: str) -> str:
    return (f"SELECT '{column}' AS \"column\", {q6(f'min({column})')} AS min, {q6(f'quantile_cont({column}, 0.25)')} AS q1, "
            f"{q6(f'quantile_cont({column}, 0.5)')} AS median, {q6(f'avg({column})')} AS mean, "
            f"{q6(f'quantile_cont({column}, 0.75)')} AS q3, {q6(f'max({column})')} AS max, "
            f"count(*) - count({column}) AS missing FROM {source}")


def shown_summary(df):
    return df.select("column", *[r6(c).alias(c) for c in ("min", "q1", "median", "mean", "q3", "max")], "missing")


@query("a08_summary_readings", summary_sql("meter_reading", "readings WHERE meter = 0"))
def summary_readings(w):
    return shown_summary(order_stats.column_summary(electricity(w), ["meter_reading"]))


@query("a08_summary_weather", " UNION ALL ".join(summary_sql(m, "weather") for m in WEATHER_MEASURES))
def summary_weather(w):
    return shown_summary(order_stats.column_summary(w.weather, WEATHER_MEASURES))


@query("a08_summary_buildings", " UNION ALL ".join(
    summary_sql(c, "buildings") for c in ("square_feet", "year_built", "floor_count")))
def summary_buildings(w):
    return shown_summary(order_stats.column_summary(w.buildings, ["square_feet", "year_built", "floor_count"]))


@query("a09_level_counts", """
SELECT CASE WHEN hour BETWEEN 5 AND 11 THEN 'Morning' WHEN hour BETWEEN 12 AND 16 THEN 'Afternoon'
            WHEN hour BETWEEN 17 AND 20 THEN 'Evening' ELSE 'Night' END AS time, count(*) AS n
FROM readings GROUP BY 1
""")
def level_counts(w):
    rows = projections.with_day_hour(w.readings).withColumn("time", time_of_day("hour"))
    return aggregates.level_counts(rows, "time")


@query("a10_null_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM weather" for c in WEATHER_MEASURES))
def null_counts(w):
    return aggregates.null_counts(w.weather.select(*WEATHER_MEASURES))


@query("a11_total_nulls", "SELECT CAST(" + " + ".join(f"count(*) - count({c})" for c in WEATHER_MEASURES)
       + " AS BIGINT) AS nulls FROM weather")
def total_nulls(w):
    return aggregates.total_nulls(w.weather)


A12 = ["year_built", "floor_count", "square_feet"]


@query("a12_means_per_group_complete", f"""
SELECT primary_use, {', '.join(f"{q6(f'avg({c})')} AS {c}" for c in A12)} FROM buildings
WHERE {' AND '.join(f'{c} IS NOT NULL' for c in A12)} GROUP BY 1
""")
def means_per_group_complete(w):
    means = aggregates.mean_of_all(w.buildings.select("primary_use", *A12), "primary_use", complete_only=True)
    return means.select("primary_use", *[r6(c).alias(c) for c in A12])


@query("a13_means_per_hour", f"""
SELECT CAST(extract(hour FROM "timestamp") AS BIGINT) AS hour, {q6(strict('wind_speed'))} AS wind_speed,
       {q6(strict('air_temperature'))} AS air_temperature FROM weather GROUP BY 1
""")
def means_per_hour(w):
    rows = projections.with_day_hour(w.weather).select("hour", "wind_speed", "air_temperature")
    means = aggregates.mean_of_all(rows, "hour")
    return means.select(big("hour").alias("hour"), r6("wind_speed").alias("wind_speed"),
                        r6("air_temperature").alias("air_temperature"))


@query("a14_two_way_table", """
SELECT CAST(quality AS BIGINT) AS quality, count(CASE WHEN toxic = 0 THEN 1 END) AS "0", count(CASE WHEN toxic = 1 THEN 1 END) AS "1"
FROM labels GROUP BY 1
""", views=False)
def two_way_table(w):
    table = aggregates.two_way_table(w.table("labels"), "quality", "toxic", [0, 1])
    return table.withColumn("quality", big("quality"))


@query("a15_class_counts", "SELECT primary_use, count(*) AS n FROM buildings GROUP BY 1")
def class_counts(w):
    return aggregates.level_counts(w.buildings, "primary_use")


@query("a16_box_fences", FENCES + f"""
SELECT {q6('lower_hinge')} AS lower_hinge, {q6('upper_hinge')} AS upper_hinge, {q6('low')} AS low, {q6('high')} AS high FROM fences
""")
def box_fences(w):
    f = order_stats.box_fences(electricity(w), "meter_reading")
    return w.spark.range(1).select(r6(F.lit(f.lower_hinge)).alias("lower_hinge"), r6(F.lit(f.upper_hinge)).alias("upper_hinge"),
                                   r6(F.lit(f.lower)).alias("low"), r6(F.lit(f.upper)).alias("high"))


@query("a16_outliers", FENCES + f"""
SELECT building_id, {q6('meter_reading')} AS meter_reading FROM readings, fences
WHERE meter = 0 AND (meter_reading < low OR meter_reading > high)
""")
def outliers(w):
    rows = order_stats.outliers(electricity(w), "meter_reading")
    return rows.select("building_id", r6("meter_reading").alias("meter_reading"))


@query("a17_mode", """
SELECT precip_depth_1_hr, count(*) AS n FROM weather WHERE precip_depth_1_hr IS NOT NULL
GROUP BY 1 ORDER BY n DESC, precip_depth_1_hr LIMIT 1
""")
def mode(w):
    return aggregates.mode_of(w.weather, "precip_depth_1_hr")


@query("a18_size", """
SELECT count(*) AS n_rows, CAST(4 AS BIGINT) AS n_columns, count(CASE WHEN meter_reading >= 50 THEN 1 END) AS n_true FROM readings
""")
def size(w):
    return aggregates.size_of(w.readings, F.col("meter_reading") >= 50)


@query("a19_group_and_regroup", f"""
, cells AS (SELECT building_id, day, hour, avg(meter_reading) AS v FROM readings WHERE meter = 0 GROUP BY 1, 2, 3)
SELECT building_id, count(*) AS cells, {q6('avg(v)')} AS mean_of_cells FROM cells GROUP BY 1
""")
def group_and_regroup(w):
    cells = aggregates.weekly_profile(electricity(w), with_sd=False)
    return cells.groupBy("building_id").agg(F.count(F.lit(1)).alias("cells"),
                                            r6(F.avg("avg_meter_reading")).alias("mean_of_cells"))


# Reshaping. The SQL lists the slot columns, because their names are fixed.
SLOTS = week_slots()
CELLS = """
, cells AS (SELECT building_id, '2020-11-0' || day || ' ' || lpad(CAST(hour AS VARCHAR), 2, '0') || ':00:00' AS slot,
                   avg(meter_reading) AS a, stddev_samp(meter_reading) AS s
            FROM readings WHERE meter = 0 GROUP BY building_id, day, hour)
"""


def wide_columns(value: str, prefix: str) -> str:
    return ", ".join(f"{q6(f'''max(CASE WHEN slot = '{s}' THEN {value} END)''')} AS \"{prefix}{s}\"" for s in SLOTS)


def slots_of(w, with_sd: bool):
    return reshape.with_slot(aggregates.weekly_profile(electricity(w), with_sd))


def shown_wide(df):
    return df.select("building_id", *[r6(f"`{c}`").alias(c) for c in df.columns[1:]])


@query("r01_widen", CELLS + f"SELECT building_id, {wide_columns('a', '')} FROM cells GROUP BY 1")
def widen(w):
    return shown_wide(reshape.widen_weekly(aggregates.weekly_profile(electricity(w), False), ["avg_meter_reading"]))


@query("r02_widen_two_values", CELLS + f"""
SELECT building_id, {wide_columns('a', 'avg_meter_reading_electric_')}, {wide_columns('s', 'sd_meter_reading_electric_')}
FROM cells GROUP BY 1
""")
def widen_two_values(w):
    values = ["avg_meter_reading", "sd_meter_reading"]
    return shown_wide(reshape.widen_weekly(aggregates.weekly_profile(electricity(w), True), values, infix="electric_"))


@query("r03_lengthen", f"""
SELECT building_id, variable, {q6('value')} AS value FROM (
  {' UNION ALL '.join(f"SELECT building_id, '{c}' AS variable, CAST({c} AS DOUBLE) AS value FROM buildings"
                      for c in ('square_feet', 'year_built', 'floor_count'))})
""")
def lengthen(w):
    wide = w.buildings.select("building_id", *[F.col(c).cast("double").alias(c)
                                               for c in ("square_feet", "year_built", "floor_count")])
    return reshape.lengthen(wide, ["building_id"]).withColumn("value", r6("value"))


def use_means(w):
    return aggregates.mean_of_all(
        w.buildings.select("primary_use", F.col("square_feet"), F.col("site_id").cast("double").alias("site_id")),
        "primary_use")


USES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("r04_flip", " UNION ALL ".join(
    f"SELECT '{c}' AS variable, " + ", ".join(f"{q6(f'''avg(CASE WHEN primary_use = '{u}' THEN {c} END)''')} AS \"{u}\"" for u in USES)
    + " FROM buildings" for c in ("square_feet", "site_id")))
def flip(w):
    flipped = reshape.flip(use_means(w), "primary_use", USES)
    return flipped.select("variable", *[r6(u).alias(u) for u in USES])


@query("r05_names_to_column", "SELECT * FROM (VALUES ('square_feet'), ('site_id')) AS t(hour)", views=False)
def names_to_column(w):
    return reshape.flip(use_means(w), "primary_use", USES, name="hour").select("hour")


@query("r06_slot_hour", CELLS + f"""
SELECT building_id, CAST(substr('avg_meter_reading_electric_' || slot, 39, 2) AS BIGINT) AS hour, {q6('avg(a)')} AS value
FROM cells GROUP BY 1, 2
""")
def slot_hour(w):
    wide = reshape.widen(slots_of(w, False), "building_id", "slot", ["avg_meter_reading"], infix="electric_")
    long = reshape.lengthen(wide, ["building_id"]).where(F.col("value").isNotNull())
    hours = long.withColumn("hour", big(reshape.slot_hour("variable")))
    return hours.groupBy("building_id", "hour").agg(r6(F.avg("value")).alias("value"))
