"""Feature preparation, models, clustering and evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattweave.catalog.base import big, q6, qstamp, query, r6, stamp, strict
from wattweave.functions.vectors import row_zscore
from wattweave.operators import boosting, clustering, estimators, evaluation, filters, grids, knn, linkage, models, ranking
from wattweave.operators.discriminant import fit_discriminant
from wattweave.plans.classify import classify_by_discriminant, classify_by_forest, hold_out
from wattweave.sources.shared import materialise

POSITIONS = "SELECT vec_id, label, unnest(embedding) :: DOUBLE AS x, unnest(range(64)) AS pos FROM embeddings"


def exploded(df, features="features"):
    return df.select("vec_id", F.posexplode(features).alias("pos", "x")).select(
        "vec_id", big("pos").alias("pos"), r6("x").alias("x"))


@query("m01_column_scale", f"""
WITH p AS ({POSITIONS}), s AS (SELECT pos, avg(x) AS m, stddev_samp(x) AS sd FROM p GROUP BY 1)
SELECT vec_id, pos, {q6('(x - m) / sd')} AS x FROM p JOIN s USING (pos)
""", views=False)
def column_scale(w):
    scaler = knn.fit_scaler(w.vectors)
    return exploded(w.vectors.withColumn("features", scaler.apply("features")))


@query("m02_row_scale", f"""
WITH p AS ({POSITIONS}), s AS (SELECT vec_id, avg(x) AS m, stddev_samp(x) AS sd FROM p GROUP BY 1)
SELECT vec_id, pos, {q6('(x - m) / sd')} AS x FROM p JOIN s USING (vec_id)
""", views=False)
def row_scale(w):
    return exploded(w.vectors.withColumn("features", row_zscore("features")))


@query("m03_formula_features", """
, whole AS (SELECT * FROM buildings WHERE year_built IS NOT NULL AND floor_count IS NOT NULL AND square_feet IS NOT NULL
            AND primary_use IS NOT NULL AND site_id IS NOT NULL),
classes AS (SELECT primary_use, row_number() OVER (ORDER BY count(*) DESC, primary_use) - 1 AS y FROM whole GROUP BY 1)
SELECT building_id, CAST(y AS DOUBLE) AS y, [CAST(square_feet AS DOUBLE), CAST(year_built AS DOUBLE), CAST(floor_count AS DOUBLE)] AS vector
FROM whole JOIN classes USING (primary_use)
""")
def formula_features(w):
    rows = models.formula_features(w.buildings.dropna(), "primary_use ~ . - site_id - building_id")
    return rows.select("building_id", "y", vector_to_array("vector").alias("vector"))


@query("m04_stratified_split", """
, ranked AS (SELECT building_id, primary_use,
    row_number() OVER (PARTITION BY primary_use ORDER BY md5(building_id || ':356'), building_id) AS r,
    count(*) OVER (PARTITION BY primary_use) AS n FROM buildings)
SELECT building_id, primary_use, CAST(r <= ceil(n * CAST(0.7 AS DOUBLE)) AS BIGINT) AS is_train FROM ranked
""")
def stratified_split(w):
    parts = ranking.stratified_split(w.buildings, "primary_use", "building_id")
    return parts.select("building_id", "primary_use", big("is_train").alias("is_train"))


TRAIN = "CAST('0x' || substr(md5({key} || ':1'), 1, 8) AS BIGINT) < floor(CAST(0.8 AS DOUBLE) * 4294967296)"


@query("m05_random_split", f"SELECT building_id, CAST({TRAIN.format(key='building_id')} AS BIGINT) AS is_train FROM buildings")
def random_split(w):
    return ranking.random_split(w.buildings, "building_id").select("building_id", big("is_train").alias("is_train"))


@query("m06_stratified_folds", """
SELECT vec_id, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(vec_id || ':100'), vec_id) - 1) % 10 AS BIGINT) AS fold
FROM embeddings
""", views=False)
def stratified_folds(w):
    return ranking.stratified_folds(w.vectors, "label", "vec_id").select("vec_id", big("fold").alias("fold"))


@query("m07_knn_regression", f"""
WITH p AS ({POSITIONS}), t AS (SELECT vec_id, label, {TRAIN.format(key='vec_id')} AS is_train FROM embeddings),
s AS (SELECT pos, avg(x) AS m, stddev_samp(x) AS sd FROM p JOIN t USING (vec_id) WHERE is_train GROUP BY 1),
z AS (SELECT vec_id, list((x - m) / sd ORDER BY pos) AS v FROM p JOIN s USING (pos) GROUP BY 1),
a AS (SELECT z.*, label FROM z JOIN t USING (vec_id) WHERE is_train),
b AS (SELECT z.* FROM z JOIN t USING (vec_id) WHERE NOT is_train),
r AS (SELECT b.vec_id, a.label, rank() OVER (PARTITION BY b.vec_id ORDER BY list_distance(a.v, b.v)) AS r FROM a, b)
SELECT vec_id, {q6('avg(label)')} AS estimate, count(*) AS neighbours FROM r WHERE r <= 9 GROUP BY 1
""", views=False)
def knn_regression(w):
    parts = ranking.random_split(w.vectors, "vec_id")
    found = knn.knn_regress(parts.where("is_train"), parts.where(~F.col("is_train")), "vec_id", "label")
    return found.select("vec_id", r6("estimate").alias("estimate"), "neighbours")


def held_out(w):
    train, test = hold_out(w.vectors.withColumn("label", F.col("label").cast("string")), "label", "vec_id")
    return train, test, models.class_labels(train, "label")


def shown_scores(scored):
    return scored.select("vec_id", "label", "predicted")


@query("m06_validated_neighbours", f"""
WITH p AS ({POSITIONS}), t AS (
  SELECT vec_id, label, (row_number() OVER (PARTITION BY label ORDER BY md5(vec_id || ':100'), vec_id) - 1) % 10 AS fold FROM embeddings),
f AS (SELECT unnest(range(10)) AS held),
s AS (SELECT held, pos, avg(x) AS m, stddev_samp(x) AS sd FROM p JOIN t USING (vec_id) JOIN f ON fold <> held GROUP BY 1, 2),
z AS (SELECT held, vec_id, list((x - m) / sd ORDER BY pos) AS v FROM p JOIN s USING (pos) GROUP BY 1, 2),
a AS (SELECT z.*, label FROM z JOIN t USING (vec_id) WHERE fold <> held),
b AS (SELECT z.*, label FROM z JOIN t USING (vec_id) WHERE fold = held),
r AS (SELECT b.held, b.vec_id, b.label AS y, a.label, rank() OVER (PARTITION BY b.vec_id ORDER BY list_distance(a.v, b.v)) AS r
      FROM a JOIN b ON a.held = b.held),
e AS (SELECT held, vec_id, any_value(y) AS y, avg(label) AS estimate FROM r WHERE r <= 9 GROUP BY 1, 2),
g AS (SELECT held, sqrt(avg(power(y - estimate, 2))) AS rmse FROM e GROUP BY 1)
SELECT 'k=9' AS setting, {q6('avg(rmse)')} AS rmse, {q6('stddev_pop(rmse)')} AS rmse_sd FROM g
""", views=False)
def validated_neighbours(w):
    report = estimators.validate_neighbours(w.vectors, "label", "label", "vec_id")
    return report.select("setting", r6("rmse").alias("rmse"), r6("rmse_sd").alias("rmse_sd"))


@query("m06_validated_discriminant")
def validated_discriminant(w):
    return estimators.validate_discriminant(w.vectors, "label", "vec_id")


@query("m08_boosted_trees")
def boosted_trees(w):
    """Ten of the 150 rounds; the README has what all of them take."""
    train, test, _ = held_out(w)
    return shown_scores(boosting.fit_boosted(train, "label", rounds=10).transform(test))


@query("m09_discriminant")
def discriminant(w):
    train, test, _ = held_out(w)
    return shown_scores(classify_by_discriminant(train, test, "label").scored)


PERCEPTRONS = {f"size={h}": grids.Perceptron(h) for h in (5, 10)}
MACHINES = {f"C={c}": grids.PairwiseMachine(c) for c in (17, 22, 25)}


@query("m10_perceptron")
def perceptron(w):
    train, test, _ = held_out(w)
    return shown_scores(grids.tune(train, "label", "vec_id", PERCEPTRONS).model.transform(test))


@query("m11_linear_svm")
def linear_svm(w):
    train, test, _ = held_out(w)
    return shown_scores(grids.tune(train, "label", "vec_id", MACHINES).model.transform(test))


@query("m12_random_forest")
def random_forest(w):
    train, test, _ = held_out(w)
    return shown_scores(classify_by_forest(train, test, "label", mtry=15).scored)


def flagged(w):
    """Buildings of one use against the rest, with their electricity statistics."""
    usage = filters.of_meter(w.readings, 0).groupBy("building_id").agg(
        F.avg("meter_reading").alias("avg_reading"), F.stddev_samp("meter_reading").alias("sd_reading"))
    rows = w.buildings.join(usage, "building_id").dropna(subset=["avg_reading", "sd_reading"])
    return rows.select("building_id", F.when(F.col("primary_use") == "BUILDING", "Education").otherwise("Other").alias("edu"),
                       F.array(*[F.col(c).cast("double") for c in PREDICTORS]).alias("features"))


PREDICTORS = ["square_feet", "site_id", "avg_reading", "sd_reading"]


@query("m13_logistic")
def logistic(w):
    parts = ranking.random_split(flagged(w), "building_id")
    model = models.logistic("edu", ["Education", "Other"]).fit(models.with_vector(parts.where("is_train")))
    scored = models.predict(model, models.with_vector(parts.where(~F.col("is_train"))))
    p = 1 - vector_to_array("probability")[1]
    return scored.select("building_id", "edu", evaluation.class_by_threshold(p, "Education", "Other").alias("predicted"))


@query("m14_predict")
def predict(w):
    model = fit_discriminant(w.vectors, "label")
    return model.transform(w.vectors).select("vec_id", "prediction", F.round("probability", 6).alias("probability"))


@query("m15_class_by_threshold", """
SELECT event_id, CASE WHEN value / 100 > 0.5 THEN 'Edu' WHEN value / 100 <= 0.5 THEN 'other' END AS class FROM events
""", views=False)
def class_by_threshold(w):
    share = F.col("value") / 100
    return w.table("events").select("event_id", evaluation.class_by_threshold(share, "Edu", "other").alias("class"))


@query("m16_accuracy", f"""
SELECT {q6('avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END)')} AS accuracy, count(*) AS n FROM labels
""", views=False)
def accuracy(w):
    return evaluation.accuracy(w.table("labels"), "quality", "toxic").withColumn("accuracy", r6("accuracy"))


@query("m17_nearest_distance", f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.vec_id, {q6('min(list_distance(a.v, b.v))')} AS distance FROM v a JOIN v b ON a.vec_id <> b.vec_id GROUP BY 1
""", views=False)
def nearest_distance(w):
    return knn.nearest_distance(w.vectors, "vec_id").select("vec_id", r6("distance").alias("distance"))


@query("m17_paired_distance", f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS other FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, {q6('list_distance(a.v, b.v)')} AS distance FROM v a JOIN v b ON b.vec_id = a.other
""", views=False)
def paired_distance(w):
    following = F.lead("vec_id").over(Window.partitionBy("label").orderBy("vec_id"))
    pairs = w.vectors.select(F.col("vec_id").alias("a"), following.alias("b")).where(F.col("b").isNotNull())
    return knn.paired_distance(pairs, w.vectors, "vec_id", "a", "b").select("a", "b", r6("distance").alias("distance"))


def scaled_vectors(w):
    return materialise(clustering.scaled_rows(w.vectors))


@query("m18_complete_linkage")
def complete_linkage(w):
    tree = linkage.complete_linkage(scaled_vectors(w), "vec_id")
    return tree.select("kept", "gone", F.round("height", 6).alias("height"))


@query("m19_cut_tree")
def cut_tree(w):
    return linkage.hierarchical_clusters(scaled_vectors(w), "vec_id", 3)


@query("m20_kmeans")
def kmeans(w):
    rows = scaled_vectors(w)
    return clustering.kmeans_clusters(rows, "vec_id", clustering.fit_kmeans(rows, 4, restarts=10))


@query("m21_elbow_curve")
def elbow_curve(w):
    return clustering.elbow_curve(scaled_vectors(w), range(1, 11))


def clusters_by_age(w):
    """A cluster number per building, from its year of construction."""
    return w.buildings.dropna(subset=["year_built"]).select(
        "building_id", F.when(F.col("year_built") < 1940, 1).when(F.col("year_built") < 1980, 2).otherwise(3).alias("cluster"))


BY_AGE = """c AS (SELECT building_id, CASE WHEN year_built < 1940 THEN 1 WHEN year_built < 1980 THEN 2 ELSE 3 END AS cluster
                  FROM buildings WHERE year_built IS NOT NULL)"""


@query("m22_cluster_usage_curve", f"""
, {BY_AGE}
SELECT CAST(cluster AS BIGINT) AS cluster, primary_use, {qstamp('make_timestamp(2020, 11, day, hour, 0, 0)')} AS date,
       {q6(strict('meter_reading'))} AS avg_meter_reading
FROM readings JOIN c USING (building_id) LEFT JOIN buildings USING (building_id) WHERE meter = 0 GROUP BY 1, 2, 3
""")
def cluster_usage_curve(w):
    curve = clustering.cluster_usage_curve(filters.of_meter(w.readings, 0), w.buildings, clusters_by_age(w))
    return curve.select(big("cluster").alias("cluster"), "primary_use", stamp("date").alias("date"),
                        r6("avg_meter_reading").alias("avg_meter_reading"))


@query("m22_cluster_usage_curve_of_month", f"""
, {BY_AGE}
SELECT CAST(cluster AS BIGINT) AS cluster, primary_use, {qstamp('make_timestamp(2020, 11, day, hour, 0, 0)')} AS date,
       {q6(strict('meter_reading'))} AS avg_meter_reading
FROM readings JOIN c USING (building_id) LEFT JOIN buildings USING (building_id)
WHERE meter = 0 AND "timestamp" >= TIMESTAMP '2024-01-01' AND "timestamp" < TIMESTAMP '2024-02-01' GROUP BY 1, 2, 3
""")
def cluster_usage_curve_of_month(w):
    rows = filters.in_month(filters.of_meter(w.readings, 0), 1, year=2024)
    curve = clustering.cluster_usage_curve(rows, w.buildings, clusters_by_age(w))
    return curve.select(big("cluster").alias("cluster"), "primary_use", stamp("date").alias("date"),
                        r6("avg_meter_reading").alias("avg_meter_reading"))


@query("m23_cluster_hourly_profile", f"""
WITH cells AS (SELECT l_suppkey AS id, extract(dow FROM l_shipdate) + 1 AS day, extract(month FROM l_shipdate) AS hour, avg(l_quantity) AS v
          FROM lineitem GROUP BY 1, 2, 3),
whole AS (SELECT id FROM cells GROUP BY 1 HAVING count(v) = 84),
slots AS (SELECT id % 3 + 1 AS cluster, day, hour, avg(v) AS v FROM cells JOIN whole USING (id) GROUP BY 1, 2, 3)
SELECT CAST(cluster AS BIGINT) AS cluster, CAST(hour AS BIGINT) AS hour, {q6('avg(v)')} AS value FROM slots GROUP BY 1, 2
""", views=False)
def cluster_hourly_profile(w):
    """Profiles of 84 slots, weekday by month of shipping, most of which are complete."""
    rows = w.table("lineitem").select(F.col("l_suppkey").alias("building_id"), F.dayofweek("l_shipdate").alias("day"),
                                      F.month("l_shipdate").alias("hour"), "l_quantity")
    profile = rows.groupBy("building_id", "day", "hour").agg(F.avg("l_quantity").alias("value"))
    clusters = w.table("supplier").select(F.col("s_suppkey").alias("building_id"), (F.col("s_suppkey") % 3 + 1).alias("cluster"))
    curve = clustering.cluster_hourly_profile(profile, clusters, slots=84)
    return curve.select(big("cluster").alias("cluster"), big("hour").alias("hour"), r6("value").alias("value"))


@query("m24_confusion", f"""
WITH c AS (SELECT quality AS target, toxic AS prediction, count(*) AS n FROM labels GROUP BY 1, 2),
s AS (SELECT *, sum(n) OVER (PARTITION BY target) AS ts, sum(n) OVER (PARTITION BY prediction) AS ps, sum(n) OVER () AS total FROM c)
SELECT CAST(target AS BIGINT) AS target, CAST(prediction AS BIGINT) AS prediction, n, CAST(ts AS BIGINT) AS target_sum,
       CAST(ps AS BIGINT) AS prediction_sum, CAST(total AS BIGINT) AS total, {q6('100.0 :: DOUBLE * n / total')} AS overall_pct,
       {q6('100.0 :: DOUBLE * n / ts')} AS target_pct, {q6('100.0 :: DOUBLE * n / ps')} AS prediction_pct
FROM s
""", views=False)
def confusion(w):
    table = evaluation.confusion(w.table("labels"), "quality", "toxic")
    return table.withColumns({"target": big("target"), "prediction": big("prediction"), "overall_pct": r6("overall_pct"),
                              "target_pct": r6("target_pct"), "prediction_pct": r6("prediction_pct")})


@query("m25_sensitivity_precision", f"""
WITH c AS (SELECT CAST(count(CASE WHEN quality = 1 AND toxic = 1 THEN 1 END) AS DOUBLE) AS tp, count(CASE WHEN quality = 1 AND toxic <> 1 THEN 1 END) AS fn,
       count(CASE WHEN quality <> 1 AND toxic = 1 THEN 1 END) AS fp, CAST(count(CASE WHEN quality <> 1 AND toxic <> 1 THEN 1 END) AS DOUBLE) AS tn FROM labels)
SELECT {q6('tp / nullif(tp + fn, 0)')} AS sensitivity, {q6('tp / nullif(tp + fp, 0)')} AS "precision", {q6('(tp + tn) / (tp + fn + fp + tn)')} AS accuracy
FROM c
""", views=False)
def sensitivity_precision(w):
    scores = evaluation.sensitivity_precision(w.table("labels"), "quality", "toxic", 1)
    return scores.select(*[r6(c).alias(c) for c in ("sensitivity", "precision", "accuracy")])


@query("m26_coefficient_report")
def coefficient_report(w):
    rows = models.with_vector(flagged(w)).withColumn("flag", (F.col("edu") == "Education").cast("double"))
    return models.coefficient_report(models.fit_binomial(rows, "flag"), PREDICTORS, w.spark)


@query("m27_classifier_comparison")
def classifier_comparison(w):
    """Accuracy over ten folds of the discriminant and of every perceptron and support vector setting."""
    rows = w.vectors.withColumn("label", F.col("label").cast("string"))
    reports = [estimators.validate_discriminant(rows, "label", "vec_id"), grids.tune(rows, "label", "vec_id", PERCEPTRONS).report,
               grids.tune(rows, "label", "vec_id", MACHINES).report]
    names = ["discriminant", "perceptron", "support vectors"]
    return reduce(DataFrame.unionAll, [r.withColumn("classifier", F.lit(n)) for r, n in zip(reports, names)])


@query("m27_tuning_report")
def tuning_report(w):
    rows = materialise(models.with_vector(w.vectors.withColumn("label", F.col("label").cast("string"))))
    labels = models.class_labels(rows, "label")
    candidates = {f"mtry={m}": models.random_forest("label", labels, mtry=m, trees=10, depth=5) for m in (8, 15, 45)}
    _, report = models.cross_validate(rows, "label", "vec_id", candidates, folds=3)
    return report
