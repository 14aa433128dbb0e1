"""Sources, sinks and schema listing."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattweave.catalog.base import big, q6, qstamp, query, r6, stamp
from wattweave.sources import tables
from wattweave.sources.schemas import READINGS, WEATHER, WEATHER_MEASURES
from wattweave.sources.shared import new_path

WEATHER_SQL = f"""
SELECT CAST(site_id AS BIGINT) AS site_id, {qstamp('"timestamp"')} AS ts,
       {', '.join(f'{q6(m)} AS {m}' for m in WEATHER_MEASURES)}
FROM weather
"""
READINGS_SQL = f"""
SELECT building_id, CAST(meter AS BIGINT) AS meter, {qstamp('"timestamp"')} AS ts, {q6('meter_reading')} AS meter_reading
FROM readings
"""


def shown_readings(df):
    return df.select("building_id", big("meter").alias("meter"), stamp("timestamp").alias("ts"),
                     r6("meter_reading").alias("meter_reading"))


@query("s01_csv_scan", WEATHER_SQL)
def csv_scan(w):
    path = new_path(w.spark, "weather-csv")
    tables.write_csv(w.weather, path)
    rows = tables.read_csv(w.spark, path, WEATHER)
    return rows.select(big("site_id").alias("site_id"), stamp("timestamp").alias("ts"),
                       *[r6(m).alias(m) for m in WEATHER_MEASURES])


SPOILT = "site_id % 4 = 1 AND wind_speed > 50"


def spoilt_csv(w):
    """The weather as CSV, with text in a numeric field of some rows."""
    path = new_path(w.spark, "spoilt-weather-csv")
    tables.write_csv(w.weather.withColumn("wind_speed", F.when(F.expr(SPOILT), F.lit("calm")).otherwise(F.col("wind_speed").cast("string"))), path)
    return tables.read_csv_checked(w.spark, path, WEATHER)


@query("s01_csv_checked", WEATHER_SQL + f"WHERE NOT ({SPOILT})")
def csv_checked(w):
    return spoilt_csv(w).rows.select(big("site_id").alias("site_id"), stamp("timestamp").alias("ts"), *[r6(m).alias(m) for m in WEATHER_MEASURES])


@query("s01_csv_rejects", f"""
SELECT CAST(site_id AS BIGINT) AS site_id, 'wind_speed' AS "columns", 'calm' AS field, count(*) AS n FROM weather WHERE {SPOILT} GROUP BY 1
""")
def csv_rejects(w):
    rows = spoilt_csv(w).rejects.select(F.col("fields")["site_id"].cast("long").alias("site_id"), F.array_join("columns", ",").alias("columns"),
                                        F.col("fields")["wind_speed"].alias("field"))
    return rows.groupBy("site_id", "columns", "field").agg(F.count(F.lit(1)).alias("n"))


@query("s02_csv_text_timestamp", READINGS_SQL)
def csv_text_timestamp(w):
    path = new_path(w.spark, "readings-csv")
    tables.write_csv(w.readings, path)
    return shown_readings(tables.read_csv_text(w.spark, path, READINGS))


@query("s03_drop_index_column", """
SELECT building_id, CAST(site_id AS BIGINT) AS site_id, primary_use FROM buildings
""")
def drop_index_column(w):
    path = new_path(w.spark, "indexed-buildings")
    tables.write_csv(w.buildings.select((F.col("building_id") + 1).alias("_c0"), "*"), path)
    indexed = w.spark.read.options(**tables.CSV_OPTIONS, nullValue="NA", inferSchema="true").csv(path)
    return tables.drop_index(indexed).select(big("building_id").alias("building_id"), big("site_id").alias("site_id"), "primary_use")


@query("s04_derived_table", """
SELECT building_id, CAST(coalesce(floor_count, 1) AS BIGINT) AS floor_count, primary_use FROM buildings
""")
def derived_table(w):
    path = new_path(w.spark, "filled-buildings")
    filled = w.buildings.withColumn("floor_count", F.coalesce("floor_count", F.lit(1)))
    tables.write_table(filled, path)
    return tables.read_table(w.spark, path, filled.schema).select(
        "building_id", big("floor_count").alias("floor_count"), "primary_use")


@query("s05_schema", """
SELECT * FROM (VALUES (1, 'site_id', 'int'), (2, 'timestamp', 'timestamp_ntz'), (3, 'air_temperature', 'double'),
  (4, 'cloud_coverage', 'double'), (5, 'dew_temperature', 'double'), (6, 'precip_depth_1_hr', 'double'),
  (7, 'sea_level_pressure', 'double'), (8, 'wind_direction', 'double'), (9, 'wind_speed', 'double')) AS t(position, "column", type)
""", views=False)
def schema(w):
    return tables.describe_schema(w.weather)
