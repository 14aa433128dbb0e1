"""What the text operators share: reading a text table, joins that split hot keys, bounded memos inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattweave.sources.shared import new_path

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
HOT_SHARE = 1_000
ROW = "__row_id"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def id_and_text(docs: DataFrame, *more: Column) -> DataFrame:
    """Only the id and the text (null: empty), so that no other column of the input can clash with ours."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *more)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 1,000 rows where the session leaves them at Spark's 10,000: a batch of texts then takes a few
    megabytes on both sides of a Python worker and not some tens."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(setting, "10000") == "10000":
        spark.conf.set(setting, "1000")


def free_name(df: DataFrame, name: str) -> str:
    """The name, or the name with more underscores, so that no column of the frame has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: computed once, and no executor's loss makes Spark start over."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_counted(rows: DataFrame, classes: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join of rows to their class, `size` being the class's number of rows and `total` the number of all rows.

    A class with more than a thousandth of the rows is hot. There are fewer than a thousand of those, so they are
    broadcast and their rows are dealt out by a random key; all others meet in a shuffled join.
    """
    values = [c for c in classes.columns if c != key]
    limit = max(1, total // HOT_SHARE)
    hot = classes.where(F.col(size) > limit).select(F.col(key).alias("__hot"), *[F.col(c).alias(f"__hot_{c}") for c in values])
    cold = classes.where(F.col(size) <= limit).select(F.col(key).alias("__cold"), *[F.col(c).alias(f"__cold_{c}") for c in values])
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    spread = F.concat(F.lit("?"), F.rand(7).cast("string"))
    kind = dict(rows.dtypes)[key]
    if kind == "binary":
        spread = F.encode(spread, "utf-8")
    elif kind != "string":
        raise TypeError(f"{key} is {kind}; a string or binary key is needed")
    marked = marked.withColumn("__key", F.when(F.col("__hot").isNull(), F.col(key)).otherwise(spread))
    joined = marked.join(cold, F.col("__key") == F.col("__cold"), "left")
    return joined.select(*rows.columns, *[F.coalesce(f"__hot_{c}", f"__cold_{c}").alias(c) for c in values])


def with_row_id(docs: DataFrame) -> DataFrame:
    """The rows with a text that tells each from all others: its file and number there. A frame that does not come
    from files is stored first."""
    from pyspark.errors import AnalysisException

    try:
        return docs.withColumn(ROW, F.concat_ws("#", "_metadata.file_path", "_metadata.row_index"))
    except AnalysisException:
        return stored(docs, "rows").withColumn(ROW, F.concat_ws("#", "_metadata.file_path", "_metadata.row_index"))


#: What a worker process holds for later tasks of one kind: the functions that let it go, by kind.
HELD: dict[str, Callable[[], None]] = {}
_last = [None]


def free_memory() -> None:
    """Give freed memory back to the system: a worker process lives on for the tasks of other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library has no such call
        pass


def task(run: Callable[..., Iterator], kind: str = "") -> Callable[..., Iterator]:
    """`run` as a task of a kind: vocabularies and memos of other kinds that this worker process still holds are let go
    before it, and freed memory after it."""

    def wrapped(*args):
        from wattweave.llm import common

        if common._last[0] != kind:
            common._last[0] = kind
            for other, let_go in common.HELD.items():
                if other != kind:
                    let_go()
            common.free_memory()
        try:
            yield from run(*args)
        finally:
            common.free_memory()

    return wrapped


class Memo:
    """Values by key in two generations: what was not asked for during a whole generation is forgotten."""

    def __init__(self, room: int):
        self.room, self.new, self.old = room, {}, {}

    def lookup(self, keys: set, compute) -> dict:
        """A dictionary that has all of the keys; compute takes the list of unknown keys and returns their values."""
        if len(self.new) > self.room:
            self.new, self.old = {}, self.new
        missing = []
        for k in keys - self.new.keys():
            value = self.old.get(k)
            if value is None:
                missing.append(k)
            else:
                self.new[k] = value
        if missing:
            self.new.update(zip(missing, compute(missing)))
        return self.new


def slices(texts: list[str], chars: int = 1_000_000):
    """Runs of texts with about so many characters together; a longer text makes a run of its own."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run
