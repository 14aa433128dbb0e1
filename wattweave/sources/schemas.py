"""Declared schemas of the three input tables."""

from __future__ import annotations

from pyspark.sql import types as T

READINGS = T.StructType([
    T.StructField("building_id", T.LongType()),
    T.StructField("meter", T.IntegerType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("meter_reading", T.DoubleType()),
])

BUILDINGS = T.StructType([
    T.StructField("site_id", T.IntegerType()),
    T.StructField("building_id", T.LongType()),
    T.StructField("primary_use", T.StringType()),
    T.StructField("square_feet", T.DoubleType()),
    T.StructField("year_built", T.IntegerType()),
    T.StructField("floor_count", T.IntegerType()),
])

WEATHER_MEASURES = [
    "air_temperature", "cloud_coverage", "dew_temperature", "precip_depth_1_hr",
    "sea_level_pressure", "wind_direction", "wind_speed",
]

WEATHER = T.StructType([
    T.StructField("site_id", T.IntegerType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    *[T.StructField(name, T.DoubleType()) for name in WEATHER_MEASURES],
])


def with_text_timestamp(schema: T.StructType) -> T.StructType:
    """The same table with its timestamp left as text."""
    return T.StructType([
        T.StructField(f.name, T.StringType()) if f.name == "timestamp" else f for f in schema.fields
    ])
