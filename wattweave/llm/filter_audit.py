"""How filters interact in every order of application: removal counts by Lehmer ranks and difference arrays."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattweave.llm.common import SPACES, stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = "#$%&*|"
FILTERS = "ABCDE"


def lehmer_rank(prefix: tuple[int, ...], n: int) -> int:
    """Lexicographic rank of the first permutation of 0 … n - 1 that starts with the prefix."""
    rank = 0
    for i, x in enumerate(prefix):
        rank += (x - sum(y < x for y in prefix[:i])) * math.factorial(n - 1 - i)
    return rank


def removal_intervals(n: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, low, high): in the permutations of rank low … high - 1, a document that fails the filters of the
    mask is removed at that step. Permutations with a common prefix have neighbouring ranks: those whose first step - 1
    filters are outside the mask and whose next is in it make one interval; intervals that touch are joined."""
    out = []
    for mask in range(1, 1 << n):
        bad = [f for f in range(n) if mask >> f & 1]
        good = [f for f in range(n) if not mask >> f & 1]
        for step in range(1, len(good) + 2):
            lows = sorted(lehmer_rank((*p, f), n) for p in itertools.permutations(good, step - 1) for f in bad)
            width = math.factorial(n - step)
            start = end = lows[0]
            for low in lows:
                if low != end:
                    out.append((mask, step, start, end))
                    start = low
                end = low + width
            out.append((mask, step, start, end))
    return out


def document_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text and the mask of the filters A to D that the text alone fails.

    Words are split at the six white-space characters. Null text counts as empty, null lang as the part ''.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    words = F.split(F.translate("text", SPACES, " " * len(SPACES)), " ")
    rows = rows.select("doc_id", "part", "text", F.filter(words, lambda w: w != "").alias("words"))
    n, distinct = F.size("words").cast("long"), F.size(F.array_distinct("words")).cast("long")
    chars = F.length("text").cast("long")
    capitals = chars - F.length(F.translate("text", UPPER, ""))
    failed = [n < 100, 100 * distinct < 80 * n, 100 * capitals > 10 * chars, F.translate("text", SYMBOLS, "") != F.col("text")]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0))
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask of all five filters, and the numbers n, good and toxic of its documents.

    Filter E fails a document whose text (by SHA-256 of all its bytes) a smaller doc_id has too. Rows with one text,
    part and pair of labels become one row with its least id and that id's count before they meet by text, so a group of
    copies of any size is a few rows. Null ids are larger than any and are never smaller than each other; equal ids fail
    nothing in each other. A document is good (toxic) if any label row of its id says so; null ids have no label.
    """
    flags = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = document_masks(docs).groupBy("digest", "part", "mask", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    rows = stored(rows, "masks")
    known = rows.where("doc_id is not null").join(flags, F.col("doc_id") == F.col("__id"), "left").drop("__id")
    known = known.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    unknown = rows.where("doc_id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    groups = known.unionByName(unknown).groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("lowest"), F.min_by("n", "doc_id").alias("n_lowest"))
    least = F.min("lowest").over(Window.partitionBy("digest"))
    groups = groups.withColumn("least", least)
    first = F.when(F.col("least").isNull(), F.col("n")).when(F.col("lowest") == F.col("least"), F.col("n_lowest")).otherwise(F.lit(0))
    groups = groups.withColumn("first", first)
    copy = 1 << (len(FILTERS) - 1)
    both = F.explode(F.array(F.struct("mask", F.col("first").alias("n")),
                             F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - F.col("first")).alias("n")))).alias("m")
    split = groups.select("part", "good", "toxic", both).where("m.n > 0")
    n = F.col("m.n")
    return split.groupBy("part", F.col("m.mask").alias("mask")).agg(
        F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"))


def interaction_audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from (part, mask, n, good, toxic) with one row per mask.

    Each mask adds its counts at the low end of its intervals and takes them off at the high end; the prefix sum over
    the ranks is the number removed at that step in each order. A part has a row for each end and order, whatever the
    number of documents. No counts: no rows.
    """
    spark, size = counts.sparkSession, len(filters)
    counts = stored(counts, "mask-counts")
    intervals = spark.createDataFrame(removal_intervals(size), "mask int, step int, low int, high int")
    ends = counts.join(F.broadcast(intervals), "mask").select("part", "step", F.explode(F.array(
        F.struct(F.col("low").alias("rank"), "n", "good", "toxic"),
        F.struct(F.col("high").alias("rank"), (-F.col("n")).alias("n"), (-F.col("good")).alias("good"), (-F.col("toxic")).alias("toxic")),
    )).alias("e"))
    ends = ends.groupBy("part", "step", F.col("e.rank").alias("rank")).agg(*[F.sum(f"e.{c}").alias(f"d_{c}") for c in ("n", "good", "toxic")])

    def of_each(number):
        return F.array(*[F.sum(F.when(number(i), F.col("n")).otherwise(0)) for i in range(size)])

    parts = counts.groupBy("part").agg(
        F.sum("n").alias("total"), of_each(lambda i: F.col("mask").bitwiseAND(1 << i) != 0).alias("fails"),
        of_each(lambda i: F.col("mask") == 1 << i).alias("alone"))
    orders = ["".join(p) for p in itertools.permutations(sorted(filters))]
    grid = parts.select("*", F.posexplode(F.array(*map(F.lit, orders))).alias("rank", "filter_order"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(1), F.lit(size))).alias("step"))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    grid = grid.withColumn("filter", F.instr(F.lit("".join(sorted(filters))), letter))
    rows = grid.join(ends, ["part", "step", "rank"], "left")
    by_rank = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({name: F.sum(F.coalesce(f"d_{c}", F.lit(0))).over(by_rank)
                             for name, c in (("removed", "n"), ("good_lost", "good"), ("toxic_lost", "toxic"))})
    by_step = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    by_filter = Window.partitionBy("part", "filter")
    return rows.select(
        "part", "filter_order", "step", (F.col("total") - F.sum("removed").over(by_step)).alias("kept"), "removed",
        (F.element_at("fails", F.col("filter")) - F.col("removed")).alias("redundant"),
        F.element_at("alone", F.col("filter")).alias("unique_fails"), "good_lost", "toxic_lost",
        F.sum("removed").over(by_filter).alias("shapley"))


def document_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.

    The five filters of document_masks() and mask_counts() in all 120 orders. Empty text fails A alone (and E, if a
    smaller id is empty too). Repeated rows count each. Empty table: no rows. Other columns are not read.
    """
    return interaction_audit(mask_counts(docs, labels))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), d AS (
  SELECT doc_id, part,
         CASE WHEN len(w) < 100 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask FROM t
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY 1
), c AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM d LEFT JOIN l USING (doc_id) GROUP BY 1, 2
), f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e
  WHERE a.x <> b.x AND a.x <> c.x AND a.x <> d.x AND a.x <> e.x AND b.x <> c.x AND b.x <> d.x AND b.x <> e.x
        AND c.x <> d.x AND c.x <> e.x AND d.x <> e.x
), s AS (
  SELECT filter_order, unnest(range(1, 6)) AS step, unnest(bits) AS bit,
         unnest([0, bits[1], bits[1] + bits[2], bits[1] + bits[2] + bits[3], bits[1] + bits[2] + bits[3] + bits[4]]) AS before FROM o
), r AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (bit | before) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""
