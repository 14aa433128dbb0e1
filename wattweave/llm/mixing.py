"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattweave.llm.common import ROW, WORD, stored, with_row_id

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 20_240
IN_PARTITION = (1 << 33) - 1


def offset(seed: int) -> float:
    return random.Random(seed).random()


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target: one row per source. The window over all sources has a row per source only.

    Sources in code point order, null last, weigh `weights`, repeating. A source is capped where its share, with all
    sources of lower size per weight capped, is above `most` times its size; the rest share what the capped leave.
    All but the last division is in integers.
    """
    lcm = 1
    for w in weights:
        lcm *= w
    total, behind = Window.partitionBy(), Window.orderBy("ratio", "nth").rowsBetween(Window.unboundedPreceding, -1)
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("nth", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("ratio", F.expr(f"source_size * ({lcm} div weight)"))
    s = s.withColumn("all_size", F.sum("source_size").over(total)).withColumn("all_weight", F.sum("weight").over(total))
    s = s.withColumn("left_size", F.col("all_size") - most * F.coalesce(F.sum("source_size").over(behind), F.lit(0)))
    s = s.withColumn("left_weight", F.col("all_weight") - F.coalesce(F.sum("weight").over(behind), F.lit(0)))
    s = s.withColumn("capped", F.col("weight") * F.col("left_size") > most * F.col("source_size") * F.col("left_weight"))
    free = F.col("all_size") - most * F.sum(F.when(F.col("capped"), F.col("source_size")).otherwise(0)).over(total)
    share = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(total)
    target = F.when(F.col("capped"), (most * F.col("source_size")).cast("double")).otherwise(
        (F.col("weight") * free).cast("double") / share.cast("double"))
    return s.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED,
        row: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target and copies of every document.

    Each document's expected number of copies is its source's target by its source's size. Documents of a source are
    laid out by size, then doc_id; copies are the integer borders between the sums of expected copies before and after
    the document, moved by one random offset. Neighbours are of like size, so the words taken come near the target.
    The order is made by range partitions, a sum per partition and source, and the place in the partition: a source
    may have any share of the rows. Null text: size 0. Null source: a source of its own, after all others. Null doc_id
    goes last in its size. Repeated rows count each. An empty source or table has targets of 0. Other columns are not
    read, but for `row`, the name of a string column that is carried along as `__row`.
    """
    light = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source",
                               F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                               (F.col(row) if row else F.lit(None)).cast("string").alias("__row")), "sizes")
    key = [F.col("source").asc_nulls_last(), F.col("size").asc(), F.col("doc_id").asc_nulls_last(), F.col("__row").asc()]
    placed = light.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("at", F.monotonically_increasing_id())
    placed = stored(placed, "placed").withColumn("part", F.shiftright("at", 33)).withColumn("nth", F.col("at").bitwiseAND(F.lit(IN_PARTITION)))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("part", "source").agg(F.count(F.lit(1)).alias("n"), F.min("nth").alias("first"))
    parts = parts.select(F.col("part").alias("p"), F.col("source").alias("s"),
                         (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    targets = source_targets(light, weights, most).withColumnRenamed("source", "t")
    parts = stored(parts.join(targets, F.col("s").eqNullSafe(F.col("t"))).drop("t"), "source-parts")
    rows = placed.join(parts, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    rate = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.col("target") / F.col("source_size"))
    rank, u = F.col("nth") + F.col("shift"), F.lit(offset(seed))
    copies = F.floor((rank + 1) * rate + u) - F.floor(rank * rate + u)
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), *(["__row"] if row else []))


def taken_words(mixed: DataFrame) -> DataFrame:
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, with all their columns, each row as many times as the mix takes it."""
    rows = with_row_id(docs)
    taken = mix(rows, row=ROW, **options).where("copies > 0").select(
        F.col("__row").alias("__taken"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__nth"))
    return rows.join(taken, F.col(ROW) == F.col("__taken")).select(*docs.columns)


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), s0 AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1
), s1 AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM s0
), s2 AS (
  SELECT *, nth % 3 + 1 AS weight, source_size * (6 // (nth % 3 + 1)) AS ratio FROM s1
), s3 AS (
  SELECT *, CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER w, 0) AS BIGINT) AS left_size,
         CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS BIGINT) AS left_weight
  FROM s2 WINDOW w AS (ORDER BY ratio, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), s4 AS (
  SELECT *, weight * left_size > 3 * source_size * left_weight AS capped FROM s3
), s5 AS (
  SELECT source, source_size,
         CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE)
              ELSE CAST(weight * (sum(source_size) OVER () - 3 * sum(CASE WHEN capped THEN source_size ELSE 0 END) OVER ()) AS DOUBLE)
                   / CAST(sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () AS DOUBLE) END AS target
  FROM s4
), r AS (
  SELECT d.doc_id, d.size, s5.source_size, s5.target,
         CASE WHEN s5.source_size = 0 THEN 0 ELSE s5.target / CAST(s5.source_size AS DOUBLE) END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS LAST) - 1 AS k
  FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source
)
SELECT doc_id, size, source_size, target,
       CAST((floor(CAST(k + 1 AS DOUBLE) * rate + CAST('{offset(SEED)!r}' AS DOUBLE))
             - floor(CAST(k AS DOUBLE) * rate + CAST('{offset(SEED)!r}' AS DOUBLE))) * size AS BIGINT) AS taken
FROM r
"""
