"""Cluster the buildings of one primary use by the shape of their weekly profile."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattweave.operators.clustering import cluster_usage_curve, scaled_rows
from wattweave.operators.filters import ELECTRICITY, members_of, of_meter
from wattweave.operators.linkage import BLOCK_ROWS, hierarchical_clusters
from wattweave.plans.profiles import WEEKLY, Slots, building_slots
from wattweave.sources.shared import materialise


@dataclass(frozen=True)
class Clustered:
    clusters: DataFrame
    curves: DataFrame


def cluster_buildings(readings: DataFrame, buildings: DataFrame, use: str = "Education", k: int = 3,
                      slots: Slots = WEEKLY, with_sd: bool = True, meter: int = ELECTRICITY,
                      block_rows: int = BLOCK_ROWS) -> Clustered:
    """Complete-linkage clusters and the usage curve of each. Profiles of other uses are dropped, not their readings:
    the aggregation makes far fewer rows to join than there are readings."""
    of_use = buildings.where(F.col("primary_use") == use)
    metered = of_meter(readings, meter)
    rows = materialise(scaled_rows(members_of(building_slots(metered, slots, with_sd, meter), of_use, "building_id")))
    clusters = hierarchical_clusters(rows, "building_id", k, block_rows)
    return Clustered(clusters, cluster_usage_curve(metered, of_use, clusters))
