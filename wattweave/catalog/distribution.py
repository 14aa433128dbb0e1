"""Histogram and density tables."""

from __future__ import annotations

from wattweave.catalog.base import big, q6, query, r6, strict
from wattweave.operators import distributions, filters
from wattweave.operators.aggregates import mean_by_building_attribute

X = "x AS (SELECT meter_reading AS x FROM readings WHERE meter = 0)"


@query("d01_density_histogram", f"""
, {X}, e AS (SELECT min(x) AS lo, max(x) AS hi, CAST(count(*) AS DOUBLE) AS n, (max(x) - min(x)) / 29 AS w FROM x),
p AS (SELECT *, w / 2 + floor((lo - w / 2) / w) * w AS origin FROM e),
b AS (SELECT greatest(CAST(ceil((x - origin) / w - 1e-8) AS BIGINT), 1) AS bin, n AS total, w, origin FROM x, p)
SELECT bin, {q6('any_value(origin) + (bin - 1) * any_value(w)')} AS low, {q6('any_value(origin) + bin * any_value(w)')} AS high,
       count(*) AS n, {q6('count(*) / any_value(total) / any_value(w)')} AS density
FROM b GROUP BY bin
""")
def density_histogram(w):
    table = distributions.density_histogram(filters.of_meter(w.readings, 0), "meter_reading")
    return table.select(big("bin").alias("bin"), r6("low").alias("low"), r6("high").alias("high"), "n",
                        r6("density").alias("density"))


@query("d02_kernel_density", f"""
, {X}, e AS (SELECT min(x) AS lo, max(x) AS hi, CAST(count(*) AS DOUBLE) AS n, stddev_samp(x) AS sd,
                    quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM x),
h AS (SELECT *, 0.9 * least(sd, iqr / 1.34) * power(n, -0.2) AS bw FROM e),
g AS (SELECT *, lo - 4 * bw AS origin, (hi - lo + 8 * bw) / 511 AS step, (hi - lo) / 511 AS out_step FROM h),
shares AS (SELECT CAST(floor((x - origin) / step) AS BIGINT) AS cell, (x - origin) / step - floor((x - origin) / step) AS part FROM x, g),
grid AS (SELECT pos, sum(wt) AS wt FROM (SELECT cell AS pos, 1 - part AS wt FROM shares UNION ALL SELECT cell + 1, part FROM shares) GROUP BY 1),
points AS (SELECT i AS point, lo + i * out_step AS px, (lo - origin + i * out_step) / step AS place FROM g, range(512) AS t(i)),
placed AS (SELECT *, least(CAST(floor(place) AS BIGINT), 510) AS lft FROM points)
SELECT point, {q6('any_value(px)')} AS x,
       {q6('''sum(wt * ((1 - (place - lft)) * exp(-0.5 * power((lft - pos) * step / bw, 2))
                    + (place - lft) * exp(-0.5 * power((lft + 1 - pos) * step / bw, 2)))) / any_value(bw * sqrt(2 * pi()) * n)''')} AS density
FROM placed, grid, g GROUP BY point
""")
def kernel_density(w):
    table = distributions.kernel_density(filters.of_meter(w.readings, 0), "meter_reading")
    return table.select(big("point").alias("point"), r6("x").alias("x"), r6("density").alias("density"))


@query("d03_count_histogram", """
, x AS (SELECT building_id AS x FROM readings WHERE meter = 0),
e AS (SELECT CAST(min(x) AS DOUBLE) AS lo, (max(x) - min(x)) / ceil(log2(count(*)) + 1) AS raw FROM x),
u AS (SELECT *, power(10.0, floor(log10(raw))) AS unit FROM e),
s AS (SELECT lo, CASE WHEN 2 * unit - raw >= 1.5 * (raw - unit) THEN unit
                      WHEN 5 * unit - raw >= 2.75 * (raw - 2 * unit) THEN 2 * unit
                      WHEN 10 * unit - raw >= 1.5 * (raw - 5 * unit) THEN 5 * unit ELSE 10 * unit END AS w FROM u),
p AS (SELECT w, floor(lo / w + 1e-7) * w AS origin FROM s),
b AS (SELECT greatest(CAST(ceil((x - origin) / w - 1e-8) AS BIGINT), 1) AS bin, origin, w FROM x, p)
SELECT bin, any_value(origin) + (bin - 1) * any_value(w) AS low, any_value(origin) + bin * any_value(w) AS high, count(*) AS n
FROM b GROUP BY bin
""")
def count_histogram(w):
    table = distributions.count_histogram(filters.of_meter(w.readings, 0), "building_id")
    return table.withColumn("bin", big("bin"))


@query("d04_order_by_mean", f"""
, m AS (SELECT primary_use, {strict('meter_reading')} AS v FROM readings LEFT JOIN buildings USING (building_id)
        WHERE meter = 0 GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY v) AS BIGINT) AS position, primary_use, {q6('v')} AS avg_meter_reading FROM m
""")
def order_by_mean(w):
    means = mean_by_building_attribute(filters.of_meter(w.readings, 0), w.buildings, [], ["primary_use"])
    ordered = distributions.in_order_of(means, "avg_meter_reading")
    return ordered.select(big("position").alias("position"), "primary_use", r6("avg_meter_reading").alias("avg_meter_reading"))
