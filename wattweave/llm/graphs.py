"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattweave.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the least node that can be reached.

    Large-star and small-star steps in turn until nothing changes, about the square of the logarithm of the longest
    path. Each round is stored, so a lost executor does not start the loop anew. A centre with very many edges is split
    by the skew join.
    """
    nodes = stored(edges.select(F.col("a").alias("node")).unionAll(edges.select(F.col("b").alias("node"))).distinct(), "nodes")
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    before = None
    while True:
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionAll(pairs.groupBy("u").agg(F.min("v").alias("v"))).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        step = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = stored(step.unionAll(small.select("u", F.col("m").alias("v"))).distinct(), "stars")
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return nodes.join(pairs.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"))
