"""K-means with restarts, the elbow curve and per-cluster profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattweave.functions.dates import week_anchor
from wattweave.functions.stats import mean_of_parts, mean_parts
from wattweave.functions.vectors import is_complete, row_zscore
from wattweave.operators.blocks import collected_sums, to_blocks
from wattweave.operators.knn import matrix, squared_gaps
from wattweave.operators.projections import with_day_hour

#: Rows whose distances to the centres of all models are held at once.
SCAN_ROWS = 1_024


def scaled_rows(df: DataFrame, features: str = "features") -> DataFrame:
    """Rows scaled to mean 0 and sd 1 each; rows with a gap or without spread are left out."""
    scaled = df.withColumn(features, row_zscore(features))
    return scaled.where(is_complete(features))


def start_rows(df: DataFrame, n: int, seed: int, features: str) -> np.ndarray:
    """Up to n distinct rows, chosen by a hash; n does not grow with the data."""
    distinct = df.groupBy(features).agg(F.lit(1).alias("one")).select(features, F.xxhash64(features, F.lit(seed)).alias("at"))
    return np.array([r[0] for r in distinct.orderBy("at", features).limit(n).collect()], float)


def lloyd(df: DataFrame, ks: list[int], restarts: int = 10, seed: int = 1, iterations: int = 100,
          features: str = "features") -> dict[int, tuple[float, np.ndarray]]:
    """Per number of clusters, the least within-cluster sum of squares of all restarts and its centres.

    All models, each k with each restart, move together: one scan of the packed rows an iteration sums the rows of every
    centre of every model, until none moves or `iterations` are done. The first centres are rows chosen by hash, others
    for each restart; with fewer distinct rows than k there are as many centres as rows. A centre without rows stays.
    """
    blocks = to_blocks(df, features)
    rows = start_rows(df, max(ks) * restarts, seed, features)
    if not len(rows):
        return {}
    models = [(k, r) for k in ks for r in range(restarts)]
    centres = {i: rows[[(r * max(ks) + j) % len(rows) for j in range(min(k, len(rows)))]] for i, (k, r) in enumerate(models)}
    moving = set(centres)
    p = rows.shape[1]

    def gathered(x, y, fold):
        some = sorted(moving)
        places = list(zip(some, np.cumsum([0] + [len(centres[i]) for i in some[:-1]])))
        for a in range(0, len(x), SCAN_ROWS):
            part = x[a : a + SCAN_ROWS]
            gaps = squared_gaps(np.concatenate([centres[i] for i in some]), part)  # one product for all models
            member = np.empty(gaps.shape)
            for i, at in places:
                near = gaps[at : at + len(centres[i])]
                np.equal(near, near.min(0), out=member[at : at + len(centres[i])])
            sums = np.column_stack([member @ part, member.sum(1)])
            for i, at in places:
                own = slice(at, at + len(centres[i]))
                if sums[own, p].sum() != len(part):  # a row that is as near to two: the first has it
                    first = np.eye(len(centres[i]))[gaps[own].argmin(0)].T
                    sums[own] = np.column_stack([first @ part, first.sum(1)])
                yield i, sums[own].ravel()

    for _ in range(iterations):
        found = collected_sums(blocks, gathered)
        for i in sorted(moving):
            sums = found[i].reshape(-1, p + 1)
            filled = sums[:, p] > 0
            new = np.where(filled[:, None], sums[:, :p] / np.maximum(sums[:, p : p + 1], 1), centres[i])
            if np.abs(new - centres[i]).max() < 1e-9:
                moving.discard(i)
            centres[i] = new
        if not moving:
            break

    def cost(x, y, fold):
        for i, c in centres.items():
            gap = x - c[squared_gaps(x, c).argmin(1)]
            yield i, np.array([np.einsum("ij,ij->", gap, gap)])

    costs = collected_sums(blocks, cost)
    best = {}
    for i, (k, _) in enumerate(models):
        if k not in best or costs[i][0] < best[k][0]:
            best[k] = float(costs[i][0]), centres[i]
    return best


def fit_kmeans(df: DataFrame, k: int, restarts: int = 10, seed: int = 1, features: str = "features") -> np.ndarray:
    """Centres of the best of several k-means runs by within-cluster sum of squares."""
    return lloyd(df, [k], restarts, seed, features=features)[k][1]


def kmeans_clusters(df: DataFrame, key: str, centres: np.ndarray, features: str = "features") -> DataFrame:
    """(key, cluster 1 … k): the nearest centre, the first of equals."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = squared_gaps(matrix(b.column(features)), centres).argmin(1) + 1 if b.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(own.astype(np.int32))], names=[key, "cluster"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, features).mapInArrow(place, f"`{key}` {kind}, cluster int")


def elbow_curve(df: DataFrame, ks: range = range(1, 11), restarts: int = 10, seed: int = 1,
                features: str = "features") -> DataFrame:
    """Total within-cluster sum of squares per number of clusters: (k, total_wss)."""
    best = lloyd(df, list(ks), restarts, seed, features=features)
    return df.sparkSession.createDataFrame([(k, best[k][0]) for k in ks if k in best], "k int, total_wss double")


def cluster_usage_curve(readings: DataFrame, buildings: DataFrame, clusters: DataFrame) -> DataFrame:
    """Mean reading per cluster, primary use, weekday and hour, for buildings that have a cluster."""
    cells = with_day_hour(readings).groupBy("building_id", "day", "hour").agg(*mean_parts("meter_reading"))
    labelled = (cells.join(clusters.select("building_id", "cluster"), "building_id")
                .join(buildings.select("building_id", "primary_use"), "building_id", "left"))
    curve = labelled.groupBy("cluster", "primary_use", "day", "hour").agg(
        mean_of_parts().alias("avg_meter_reading"))
    return curve.withColumn("date", week_anchor("day", "hour"))


def cluster_hourly_profile(profile: DataFrame, clusters: DataFrame, value: str = "value",
                           slots: int = 168) -> DataFrame:
    """Mean per cluster and slot, then averaged over the slots of each hour: (cluster, hour, value).

    ``profile`` is long: building_id, day, hour and the (scaled) value. Only buildings that have a value in each of
    the ``slots`` cells of a profile take part: neither a null nor an absent cell is let through.
    """
    whole = profile.groupBy("building_id").agg(F.count(value).alias("filled")).where(F.col("filled") == slots)
    rows = (profile.join(clusters.select("building_id", "cluster"), "building_id")
            .join(whole.select("building_id"), "building_id", "left_semi"))
    slots = rows.groupBy("cluster", "day", "hour").agg(F.avg(value).alias("slot_mean"))
    return slots.groupBy("cluster", "hour").agg(F.avg("slot_mean").alias(value))
