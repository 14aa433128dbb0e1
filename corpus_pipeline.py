"""A training corpus from the documents: each stage works on all rows that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattweave.llm import language_id, mixing
from wattweave.llm.chosen_path import similar_texts
from wattweave.llm.common import ROW, documents, stored, with_row_id
from wattweave.llm.exact_dedup import exact_groups
from wattweave.llm.piece_codec import piece_digests

#: SQL can express neither the learned language model nor the approximate join: the stages are tested by brute force.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model can name; without text or letters there is none.

    Null, empty and letterless texts go, and so do all rows if none has both a language and a doc_id to learn from. A
    text goes, too, whose best score is below half of what the lowest thousandth of held-back training rows reach: it is
    in no language of the table, or noise. Long texts are scored whole, in windows. Repeated rows are judged alike: all
    stay or all go. Empty table: no rows. All columns are passed on.
    """
    return language_id.with_language(docs)


def one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text but for white space, the one that op10 keeps.

    That is the longest original text, then the smallest doc_id (null last), then the first by place. Null and empty
    texts are one group, of which one row stays; of repeated rows one stays. Empty table: no rows. All columns are
    passed on; a table with a column `_metadata` or `__row_id` is not supported.
    """
    rows = with_row_id(docs)
    kept = exact_groups(rows, row=ROW).where("kept").select(F.col("row").alias("__kept"))
    return rows.join(kept, F.col(ROW) == F.col("__kept"), "left_semi").select(*docs.columns)


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by a Jaccard similarity of 0.8 or more, the one with the smallest doc_id.

    Null doc_ids come after all others. Texts without words are in no group and stay; of repeated rows with words one
    stays. Empty table: no rows. All columns are passed on, but for the names that `one_of_copies` does not support.
    """
    rows = with_row_id(docs)
    kept = similar_texts(rows, row=ROW).where("kept").select(F.col("row").alias("__kept"))
    return rows.join(kept, F.col(ROW) == F.col("__kept"), "left_semi").select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    A row may be taken never, once or up to three times; the copies are equal rows. Null texts have size 0 and null
    sources are a source of their own, last; a source without a word is not taken. Rows of equal size are laid out by
    doc_id (null last), then by place, so reruns over the same files agree. Empty table: no rows. All columns are passed
    on, but for the names that `one_of_copies` does not support.
    """
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text.

    Null texts count as empty: no token, and the digests of the empty string. Null doc_ids and repeated rows stay, a row
    each; long texts are encoded whole. Empty table: no rows. Other columns are not read.
    """
    return piece_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("language_id", known_language), ("exact_dedup", one_of_copies), ("similar_texts", one_of_similar),
          ("source_mix", mixed_sources), ("piece_codec", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
