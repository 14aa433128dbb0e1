"""Stores, layouts and the life of intermediate tables."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wattweave.operators import joins, reshape
from wattweave.operators.aggregates import weekly_profile
from wattweave.plans import store
from wattweave.sources import shared, tables
from wattweave.sources.schemas import WEATHER

TEXT = "building_id long, meter int, ts string, meter_reading double"


def readings_of(spark, rows):
    return spark.createDataFrame(rows, TEXT).select("building_id", "meter", F.col("ts").cast("timestamp_ntz").alias("timestamp"), "meter_reading")


JANUARY = [(1, 0, "2016-01-04 05:00:00", 1.0), (1, 0, "2016-01-11 05:00:00", 4.0), (1, 1, "2016-01-04 05:00:00", 9.0), (2, 0, "2016-01-04 05:00:00", None),
           (3, 0, "2016-01-05 01:00:00", 1e9), (3, 0, "2016-01-05 01:30:00", 1e9)]
FEBRUARY = [(1, 0, "2016-02-01 05:00:00", 7.0), (2, 0, "2016-02-01 05:00:00", 2.0), (4, 0, "2016-02-01 00:00:00", None)]


def test_an_update_of_the_store_equals_a_full_build(spark, tmp_path):
    path = str(tmp_path / "store")
    both = [readings_of(spark, rows) for rows in (JANUARY, FEBRUARY)]
    for rows in both:
        store.update_store(rows, path)
    got = sorted(map(tuple, store.stored_profile(store.read_store(spark, path), 0).collect()))
    want = weekly_profile(both[0].unionByName(both[1]).where("meter = 0"))
    assert got == sorted(map(tuple, want.select("building_id", "day", "hour", "avg_meter_reading", "sd_meter_reading").collect()))


def test_an_update_leaves_other_periods_alone_and_replaces_its_own(spark, tmp_path):
    path = str(tmp_path / "store")
    for rows in (JANUARY, FEBRUARY, FEBRUARY):
        store.update_store(readings_of(spark, rows), path)
    kept = {p: sorted(f.name for f in Path(path, f"period={p}").glob("*.parquet")) for p in ("2016-01-01", "2016-02-01")}
    store.update_store(readings_of(spark, [(1, 0, "2016-02-01 05:00:00", 70.0)]), path)
    assert sorted(f.name for f in Path(path, "period=2016-01-01").glob("*.parquet")) == kept["2016-01-01"]
    assert store.read_store(spark, path).where("period = '2016-02-01'").select("mean").collect() == [(70.0,)]


def test_stored_layout_joins_without_an_exchange(spark):
    rows = readings_of(spark, JANUARY).withColumn("site_id", F.col("building_id").cast("int") % 2)
    weather = spark.createDataFrame([(1, "2016-01-04 05:00:00", 3.0), (0, "2016-01-05 01:00:00", 5.0)], "site_id int, ts string, wind_speed double")
    weather = weather.select("site_id", F.col("ts").cast("timestamp_ntz").alias("timestamp"), "wind_speed")
    joined = joins.with_stored_weather(*joins.store_by_site_hour(rows, weather, buckets=4))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    got = sorted((r.building_id, str(r.timestamp), r.wind_speed) for r in joined.collect())
    assert got == sorted((r.building_id, str(r.timestamp), r.wind_speed) for r in joins.with_weather(rows, weather).collect())


def test_bad_fields_reject_their_rows_only(spark, tmp_path):
    text = "wind_speed,site_id,timestamp,air_temperature,cloud_coverage,dew_temperature,precip_depth_1_hr,sea_level_pressure,wind_direction,extra\n"
    text += '1.5,1,2016-01-01 00:00:00,NA,,,,,,x\nfast,2,2016-01-01 00:00:00,1,,,,,,\n2,x7,not a time,1,,,,,,\n'
    (tmp_path / "w.csv").write_text(text)
    checked = tables.read_csv_checked(spark, str(tmp_path / "w.csv"), WEATHER)
    assert [(r.site_id, r.wind_speed, r.air_temperature) for r in checked.rows.collect()] == [(1, 1.5, None)]
    assert checked.counts.first().asDict() == {"good": 1, "rejected": 2}
    bad = sorted((r.columns, r.fields["wind_speed"]) for r in checked.rejects.collect())
    assert bad == [(["site_id", "timestamp"], "2"), (["wind_speed"], "fast")]
    assert checked.rows.schema.simpleString() == WEATHER.simpleString()


def test_dense_slots(spark):
    long = spark.createDataFrame([(1, 3, 2.0, 5.0), (1, 0, 1.0, None), (2, 1, 3.0, 6.0), (2, 9, 1.0, 1.0), (3, -1, 1.0, 1.0), (4, None, 1.0, 1.0)],
                                 "id int, slot int, v double, w double")
    got = {r.id: r.features for r in reshape.to_dense(long, "id", "slot", ["v", "w"], 4).collect()}
    assert got == {1: [1.0, None, None, 2.0, None, None, None, 5.0], 2: [None, 3.0, None, None, None, 6.0, None, None]}


def test_dense_columns_equal_the_pivot(spark):
    profile = spark.createDataFrame([(1, 1, 0, 2.0, 0.5), (1, 7, 23, 3.0, None), (2, 4, 5, 9.0, 1.0)],
                                    "building_id long, day int, hour int, avg_meter_reading double, sd_meter_reading double")
    for values, infix in ((["avg_meter_reading"], ""), (["avg_meter_reading", "sd_meter_reading"], "electric_")):
        pivot = reshape.widen(reshape.with_slot(profile), "building_id", "slot", values, infix=infix)
        dense = reshape.widen_weekly(profile, values, infix)
        assert dense.columns == pivot.columns
        assert sorted(map(tuple, dense.collect()), key=repr) == sorted(map(tuple, pivot.collect()), key=repr)


def test_a_job_removes_what_it_made_on_the_way(spark, tmp_path):
    out = str(tmp_path / "out")
    with shared.Job(spark) as job:
        path = shared.new_path(spark, "half-way")
        spark.range(5).write.parquet(path)
        kept = shared.materialise(spark.read.parquet(path).where("id > 1"))
        job.write(kept, out)
        job.write(kept.where("id > 2"), out)
        made = list(job.paths)
    assert len(made) == 2 and not any(Path(p.removeprefix("file:")).exists() for p in made)
    assert spark.read.parquet(out).count() == 2 and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_a_job_that_fails_leaves_its_tables(spark):
    with pytest.raises(ValueError):
        with shared.Job(spark) as job:
            path = shared.new_path(spark, "half-way")
            spark.range(5).write.parquet(path)
            raise ValueError
    assert spark.read.parquet(path).count() == 5 and job not in shared.Job.active
    shared.remove(spark, path)
