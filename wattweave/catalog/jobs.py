"""The three end-to-end jobs on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattweave.catalog.base import query
from wattweave.operators import models
from wattweave.operators.impute import SMOOTHED, fill_weather
from wattweave.operators.kalman import unfilled
from wattweave.plans.classify import classify, hold_out
from wattweave.plans.clean import clean_and_impute, null_census
from wattweave.plans.cluster import cluster_buildings
from wattweave.plans.profiles import TIME_OF_DAY, building_slots, feature_frame

MERGED = ["AUTOMOBILE", "FURNITURE", "MACHINERY"]


@query("e01_classify_primary_use")
def classify_primary_use(w):
    """Random forest on profile and attributes; confusion matrix of the hold-out."""
    frame = feature_frame(building_slots(w.readings, TIME_OF_DAY), w.buildings, scale_rows=True, uses=MERGED)
    train, test = hold_out(frame, "use", "building_id")
    labels = models.class_labels(train, "use")
    return classify(train, test, "use", models.random_forest("use", labels, mtry=4, trees=50, depth=6)).confusion


@query("e02_clean_and_impute")
def clean(w):
    return clean_and_impute(w.readings, w.buildings, w.weather, TIME_OF_DAY).buildings


CENSUS = {"building_id": "building_id", "meter": "meter", "timestamp": '"timestamp"', "meter_reading": "meter_reading", "site_id": "site_id",
          "primary_use": "primary_use", "square_feet": "square_feet", "year_built": "year_built", "floor_count": "floor_count"}


@query("e02_null_census", ", j AS (SELECT * FROM readings LEFT JOIN buildings USING (building_id)) " + " UNION ALL ".join(
    f"SELECT '{name}' AS \"column\", count(*) - count({c}) AS nulls FROM j" for name, c in CENSUS.items()))
def census(w):
    return null_census(w.readings, w.buildings)


@query("e02_weather_left", " UNION ALL ".join(
    (", m AS (SELECT 1) " if i == 0 else "") + f"SELECT CAST(site_id AS BIGINT) AS site_id, '{m}' AS measure, count(*) - count({m}) AS n FROM weather "
    f"GROUP BY 1 HAVING count({m}) < 3 AND count({m}) < count(*)" for i, m in enumerate(SMOOTHED)))
def weather_left(w):
    """Nulls that the filled weather still has: those of measures with fewer than three values in a site."""
    left = unfilled(fill_weather(w.weather), [*SMOOTHED, "precip_depth_1_hr"])
    return left.select(F.col("site_id").cast("long").alias("site_id"), "measure", "n")


@query("e03_cluster_one_use")
def cluster_one_use(w):
    return cluster_buildings(w.readings, w.buildings, "BUILDING", 3, TIME_OF_DAY, with_sd=False).curves
