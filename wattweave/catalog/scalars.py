"""Scalar functions over every event."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattweave.catalog.base import big, q6, qstamp, query, r6, stamp
from wattweave.functions import dates, labels, stats
from wattweave.operators.projections import with_day_hour

TEXT = qstamp("ts")


def events(w):
    return w.table("events")


def on_events(name, sql, column):
    """Register ``event_id`` with one derived column ``x``."""
    @query(name, f"SELECT event_id, {sql} AS x FROM events", views=False)
    def run(w):
        return events(w).select("event_id", column().alias("x"))


on_events("f01_weekday", "CAST(extract(dow FROM ts) + 1 AS BIGINT)", lambda: big(dates.weekday("ts")))
on_events("f02_weekday_label", "strftime(ts, '%a')", lambda: dates.weekday_label("ts"))
on_events("f03_hour", "CAST(extract(hour FROM ts) AS BIGINT)", lambda: big(dates.hour_of("ts")))
on_events("f05_date_of_text", "strftime(CAST(ts AS DATE), '%Y-%m-%d')",
          lambda: dates.date_of_text(stamp("ts")).cast("string"))
on_events("f06_timestamp_of_text", TEXT, lambda: stamp(dates.timestamp_of_text(stamp("ts"))))
on_events("f09_concat", f"concat(event_type, ' ', {TEXT})", lambda: F.concat("event_type", F.lit(" "), stamp("ts")))
on_events("f10_regex_replace", f"regexp_replace({TEXT}, ' .*$', '')", lambda: F.regexp_replace(stamp("ts"), " .*$", ""))
on_events("f11_hour_of_text", f"CAST(substr({TEXT}, 12, 2) AS BIGINT)", lambda: big(dates.hour_of_text(stamp("ts"))))
on_events("f12_to_text", "CAST(event_id AS VARCHAR)", lambda: F.col("event_id").cast("string"))
on_events("f13_time_of_day", """CASE WHEN extract(hour FROM ts) BETWEEN 5 AND 11 THEN 'Morning'
  WHEN extract(hour FROM ts) BETWEEN 12 AND 16 THEN 'Afternoon'
  WHEN extract(hour FROM ts) BETWEEN 17 AND 20 THEN 'Evening' ELSE 'Night' END""",
          lambda: labels.time_of_day(dates.hour_of("ts")))
on_events("f15_log", f"CASE WHEN value = 0 THEN CAST('-inf' AS DOUBLE) ELSE {q6('ln(value)')} END",
          lambda: F.when(F.col("value") == 0, stats.log_natural("value")).otherwise(r6(stats.log_natural("value"))))
on_events("f16_log_shifted", q6("ln(value + 1)"), lambda: r6(stats.log_shifted("value")))
on_events("f17_round_half_even", "CAST(round_even(value, 0) AS BIGINT)", lambda: big(stats.round_half_even("value")))
on_events("f21_is_missing", "CAST(value IS NULL AS BIGINT)", lambda: big(stats.is_missing("value", is_float=True)))
on_events("f22_comparisons", "CAST((value >= 50 OR event_type = 'click') AND NOT (user_id > 10) AS BIGINT)",
          lambda: big(((F.col("value") >= 50) | (F.col("event_type") == "click")) & ~(F.col("user_id") > 10)))


@query("f04_month", "SELECT o_orderkey, CAST(extract(month FROM o_orderdate) AS BIGINT) AS x FROM orders", views=False)
def month(w):
    return w.table("orders").select("o_orderkey", big(dates.month_of("o_orderdate")).alias("x"))


@query("f07_week_anchor", f"""
SELECT building_id, {qstamp('make_timestamp(2020, 11, day, hour, 0, 0)')} AS date, count(*) AS n FROM readings GROUP BY 1, 2
""")
def week_anchor(w):
    anchored = with_day_hour(w.readings).withColumn("date", stamp(dates.week_anchor("day", "hour")))
    return anchored.groupBy("building_id", "date").agg(F.count(F.lit(1)).alias("n"))


@query("f08_month_anchor", f"""
SELECT o_orderkey, {qstamp("make_timestamp(2020, extract(month FROM o_orderdate), extract(dow FROM o_orderdate) + 1, 0, 0, 0)")} AS date
FROM orders
""", views=False)
def month_anchor(w):
    parts = with_day_hour(w.table("orders"), "o_orderdate").withColumn("month", dates.month_of("o_orderdate"))
    return parts.select("o_orderkey", stamp(dates.month_anchor("month", "day", "hour")).alias("date"))


@query("f14_binary_label", """
SELECT building_id, CASE WHEN primary_use = 'BUILDING' THEN 'Education' ELSE 'Other' END AS edu FROM buildings
""")
def binary_label(w):
    flag = labels.use_flag("primary_use", "BUILDING")
    return w.buildings.select("building_id", F.when(flag == "BUILDING", "Education").otherwise(flag).alias("edu"))


@query("f18_coalesce", "SELECT building_id, CAST(coalesce(floor_count, year_built) AS BIGINT) AS x FROM buildings")
def coalesce(w):
    return w.buildings.select("building_id", big(F.coalesce("floor_count", "year_built")).alias("x"))


@query("f19_factor", """
SELECT building_id, CAST(dense_rank() OVER (ORDER BY primary_use) - 1 AS BIGINT) AS code FROM buildings
""")
def factor(w):
    from pyspark.ml.feature import StringIndexer

    index = StringIndexer(inputCol="primary_use", outputCol="code", stringOrderType="alphabetAsc")
    return index.fit(w.buildings).transform(w.buildings).select("building_id", big("code").alias("code"))


@query("f20_collapse_levels", """
SELECT building_id, CASE WHEN primary_use IN ('AUTOMOBILE', 'FURNITURE', 'MACHINERY') THEN 'Other' ELSE primary_use END AS use
FROM buildings
""")
def collapse_levels(w):
    members = ["AUTOMOBILE", "FURNITURE", "MACHINERY"]
    return w.buildings.select("building_id", labels.collapse_uses("primary_use", members).alias("use"))
