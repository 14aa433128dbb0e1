"""Token counts through a digest cache."""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattweave.llm.common import HELD, Memo, id_and_text, join_counted, slices, stored, task
from wattweave.sources.shared import new_path

CACHE = T.StructType([T.StructField("tokenizer", T.StringType()), T.StructField("digest", T.BinaryType()),
                      T.StructField("n_tokens", T.LongType())])
ROOM = 400_000
PLAIN = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
ODD_SPACE = re.compile(r"[^\S \n\t\r]")
BORDER = re.compile(r"(?<=\S)(?=[ \n\t\r])")


def pieces(text: str) -> list[str]:
    """Cut before white space that follows a character that is none: no pre-token of byte-level BPE crosses there."""
    return BORDER.split(text) if ODD_SPACE.search(text) else PLAIN.findall(text)


class Counter:
    """Token counts of whole texts by one tokenizer file."""

    def __init__(self, path: str):
        self.memo = Memo(ROOM)
        self.cut = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.encode = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.cut = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
                    and pre.get("use_regex", True) and all(
                        not (t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]))
                        for t in spec.get("added_tokens", [])))

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.cut:
            return [n for run in slices(texts) for n in self.encode(run)]
        counts = []
        for run in slices(texts):
            cut = [pieces(t) for t in run]
            known = self.memo.lookup(set().union(*cut), self.encode)
            counts += [sum(map(known.__getitem__, x)) for x in cut]
        return counts


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


HELD["tokens"] = counter.cache_clear


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text.

    `tokenizer` is the path of a vocabulary file that every executor has, `cache` a Parquet folder in a store that all
    executors share (None: a new one in the shared folder). The counts are stored there by (tokenizer digest, text
    digest); texts that it has under this tokenizer are not encoded again, and of equal texts one is encoded.
    A text has no other normalisation than null to empty, as the tokenizer sees every byte. Null text: 0 bytes,
    0 tokens. Null doc_id and repeated rows stay, a row each. Empty table: no rows. Other columns are not read.
    """
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    cache = cache or new_path(spark, "token-cache")
    texts = id_and_text(docs).withColumn("digest", F.unhex(F.sha2("text", 256)))
    rows = stored(texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "digests")
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)

    def held() -> DataFrame:
        return spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version).select("digest", "n_tokens")

    def encode(batches):
        count = counter(tokenizer)
        for b in batches:
            n = count(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array([version] * len(n), pa.string()), b.column("digest"), pa.array(n, pa.int64())],
                names=["tokenizer", "digest", "n_tokens"])

    misses = texts.groupBy("digest").agg(F.first("text").alias("text")).join(held(), "digest", "left_anti")
    misses.select("digest", "text").mapInArrow(task(encode, "tokens"), CACHE).write.mode("append").parquet(cache)

    copies = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"))
    known = held().groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counted = stored(copies.join(known, "digest"), "token-counts")
    joined = join_counted(rows, counted, "digest", "copies", rows.count())
    return joined.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
