"""Exact duplicates by an exchange of Golomb-coded fingerprints."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattweave.llm.common import SPACES, join_counted, stored
from wattweave.llm.homes import Homes, answered, found_twice, to_owners

BITS = 64
PER_OWNER = 500_000
SETTLED = ("place long, doc_id long, n_chars long, text_sha256 string, suspect boolean, norm string, row string")


def owners_for(rows: int, per_owner: int) -> int:
    """A power of two of owners, each with about so many values."""
    return 1 << max(1, int(rows // per_owner).bit_length())


def exact_groups(docs: DataFrame, per_owner: int = PER_OWNER, row: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row.

    Texts are equal when they are without white space. Each chunk of rows sends its distinct 64-bit fingerprints,
    sorted and Golomb-coded, to their owners and gets a bit for each: met elsewhere or not. Only texts with the bit
    are shuffled, and are grouped by their bytes; the first pass over the others gives their whole answer. Each task
    brings its copies of a text down to one row before that shuffle. Null text counts as empty. Of a group stays the
    row with the most code points in the original text, then the smallest doc_id (null last), then the first by place.
    Repeated rows are copies of each other. Empty table: no rows. Other columns are not read, but for `row`, the name
    of a string column that is carried along as `row`.
    """
    spark = docs.sparkSession
    norm = F.translate(F.coalesce("text", F.lit("")), SPACES, "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), norm.alias("norm"),
                       (F.col(row) if row else F.lit(None)).cast("string").alias("row"))
    light = rows.select(F.xxhash64("norm").alias("fp"), F.octet_length("norm").alias("bytes"))
    full = rows.select(F.xxhash64("norm").alias("fp"), F.octet_length("norm").alias("bytes"), "doc_id", "n_chars",
                       F.sha2("norm", 256).alias("sha"), "norm", "row")
    first, home = Homes(light, lambda r: r[1]), Homes(full, lambda r: r[1])
    owners = owners_for(docs.count(), per_owner)
    owner_bits = owners.bit_length() - 1

    def distinct(rows_of_chunk):
        fps = np.array([r[0] for r in rows_of_chunk], np.int64).view(np.uint64)
        return np.unique(fps, return_inverse=True, return_counts=True)

    def send(part, row, rows_of_chunk):
        values, _, counts = distinct(rows_of_chunk)
        return to_owners(values, counts > 1, (part, row), BITS, owner_bits)

    def settle(part, row, rows_of_chunk, answers):
        values, inverse, _ = distinct(rows_of_chunk)
        suspect = answered(values, answers, BITS, owner_bits)[inverse]
        for i, (r, s) in enumerate(zip(rows_of_chunk, suspect.tolist())):
            yield (part << 33) + row + i, r[2], r[3], r[4], s, r[5] if s else None, r[6]

    settled = home.receive(found_twice(first.send(send, owners), owners, BITS), settle)
    settled = stored(spark.createDataFrame(settled, SETTLED, verifySchema=False), "fingerprints")

    best = F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "place")
    texts = settled.where("suspect").groupBy("text_sha256", "norm").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("size"))
    groups = texts.groupBy("text_sha256").agg(
        F.min("best").alias("best"), F.sum("size").alias("group_size"), F.count(F.lit(1)).alias("texts"))
    groups = stored(groups.select("text_sha256", "group_size", F.when(F.col("texts") > 1, F.raise_error(
        F.lit("two texts have one SHA-256"))).otherwise(F.col("best")).alias("best")), "groups")
    rest = F.coalesce("group_size", F.lit(1)).cast("long")
    light_rows = settled.select("place", "doc_id", "text_sha256", "suspect", "row")
    joined = join_counted(light_rows.where("suspect"), groups, "text_sha256", "group_size", max(1, settled.count()))
    carried = ["row"] if row else []
    alone = light_rows.where("not suspect")
    return joined.select("doc_id", F.col("best.doc_id").alias("keep_id"), rest.alias("group_size"),
                         (F.col("place") == F.col("best.place")).alias("kept"), "text_sha256", *carried).unionAll(
        alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                     F.lit(True).alias("kept"), "text_sha256", *carried))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), w AS (
  SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
"""
