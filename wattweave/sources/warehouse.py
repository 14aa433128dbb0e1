"""Star-schema Parquet tables in the shape of readings, buildings and weather."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattweave.functions.dates import to_hour
from wattweave.sources.schemas import WEATHER_MEASURES

# Event type by meter code; anything else is code 4.
EVENT_METERS = {"view": 0, "click": 1, "purchase": 2, "signup": 3}
OTHER_METER = 4
SITES = 16


class Warehouse:
    """Lazy access to the tables in one folder. Every property is a DataFrame, nothing is read up front."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def readings(self) -> DataFrame:
        code = F.lit(OTHER_METER)
        for kind, meter in EVENT_METERS.items():
            code = F.when(F.col("event_type") == kind, meter).otherwise(code)
        return self.table("events").select(
            F.col("user_id").alias("building_id"), code.alias("meter"),
            F.col("ts").alias("timestamp"), F.col("value").alias("meter_reading"))

    @cached_property
    def buildings(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.table("customer").select(
            F.col("c_nationkey").alias("site_id"), key.alias("building_id"),
            F.col("c_mktsegment").alias("primary_use"), F.col("c_acctbal").alias("square_feet"),
            F.when(key % 4 != 0, 1900 + key % 120).cast("int").alias("year_built"),
            F.when(key % 5 != 0, 1 + key % 30).cast("int").alias("floor_count"))

    @cached_property
    def weather(self) -> DataFrame:
        def mean_of(kind: str, name: str):
            return F.avg(F.when(F.col("event_type") == kind, F.col("value"))).alias(name)

        errors = F.count_if(F.col("event_type") == "error").cast("double")
        return (
            self.table("events")
            .groupBy((F.col("user_id") % SITES).cast("int").alias("site_id"), to_hour("ts").alias("timestamp"))
            .agg(mean_of("view", "air_temperature"), mean_of("click", "cloud_coverage"),
                 mean_of("purchase", "dew_temperature"),
                 F.nullif(errors, F.lit(0.0)).alias("precip_depth_1_hr"),
                 mean_of("signup", "sea_level_pressure"), mean_of("error", "wind_direction"),
                 F.max("value").alias("wind_speed"))
            .select("site_id", "timestamp", *WEATHER_MEASURES)
        )

    @cached_property
    def vectors(self) -> DataFrame:
        """Labelled 64-slot rows: vec_id, features ARRAY<DOUBLE>, label INT."""
        return self.table("embeddings").select(
            "vec_id", F.col("embedding").cast("array<double>").alias("features"), "label")
