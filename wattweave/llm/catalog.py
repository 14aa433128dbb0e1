"""The numbered queries, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers

from wattweave.llm import (chat_format, collocations, exact_dedup, filter_audit, language_id, license_scan, mixing, quality_rules,
                           topk_search)
from wattweave.llm.chosen_path import similar_texts
from wattweave.llm.common import documents
from wattweave.llm.suffix_dedup import suffix_dedup
from wattweave.llm.piece_codec import piece_digests
from wattweave.llm.token_counts import token_counts

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return add


@query("op1_token_counts")
def op1(spark, folder):
    return token_counts(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"))


@query("op6_piece_codec")
def op6(spark, folder):
    return piece_digests(documents(spark, folder), public_tokenizers.path("piece_bpe_32k.model"))


@query("op8_quality_rules", quality_rules.ORACLE)
def op8(spark, folder):
    return quality_rules.quality_rules(documents(spark, folder))


@query("op9_mixing", mixing.ORACLE)
def op9(spark, folder):
    return mixing.taken_words(mixing.mix(documents(spark, folder)))


@query("op10_exact_dedup", exact_dedup.ORACLE)
def op10(spark, folder):
    return exact_dedup.exact_groups(documents(spark, folder))


@query("op4_language_id")
def op4(spark, folder):
    return language_id.identify(documents(spark, folder))


@query("op2_suffix_dedup")
def op2(spark, folder):
    return suffix_dedup(documents(spark, folder))


@query("op3_chosen_path")
def op3(spark, folder):
    return similar_texts(documents(spark, folder))


@query("op5_chat_format", chat_format.ORACLE)
def op5(spark, folder):
    return chat_format.conversation_pairs(spark.read.parquet(f"{folder}/conversations.parquet"))


@query("op7_license_scan", license_scan.ORACLE)
def op7(spark, folder):
    return license_scan.document_licenses(documents(spark, folder))


@query("op11_topk_search", topk_search.ORACLE)
def op11(spark, folder):
    return topk_search.nearest_rows(spark.read.parquet(f"{folder}/embeddings.parquet"))


@query("op13_filter_audit", filter_audit.ORACLE)
def op13(spark, folder):
    return filter_audit.document_audit(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


@query("op12_collocations", collocations.ORACLE)
def op12(spark, folder):
    return collocations.collocations(documents(spark, folder))
