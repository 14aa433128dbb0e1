"""Numeric rows as stored blocks, and sums over them: one scan serves all models that are trained side by side."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattweave.operators.knn import matrix
from wattweave.sources.shared import materialise

BLOCK_ROWS = 4_096
TASK_ROWS = 65_536
BLOCKS = "n long, x binary, y binary, fold binary"

Work = Callable[..., Iterable[tuple[int, np.ndarray]]]


def to_blocks(df: DataFrame, features: str = "features", y: Column | None = None, fold: Column | None = None,
              task_rows: int = TASK_ROWS) -> DataFrame:
    """Rows with complete ``features`` packed as matrices of up to BLOCK_ROWS rows, with a label number and a fold each
    (0 where none is given), written to the shared folder. Few rows make few tasks."""
    rows = df.select(F.col(features).cast("array<double>").alias("x"), (F.lit(0.0) if y is None else y).cast("double").alias("y"),
                     (F.lit(0) if fold is None else fold).cast("int").alias("fold"))
    rows = rows.coalesce(max(1, -(-rows.count() // task_rows)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_ROWS):
                b = batch.slice(a, BLOCK_ROWS)
                parts = [matrix(b.column("x")), b.column("y").to_numpy(zero_copy_only=False), b.column("fold").to_numpy(zero_copy_only=False)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.num_rows], pa.int64()), *[pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts]],
                    names=["n", "x", "y", "fold"])

    return materialise(rows.mapInArrow(pack, BLOCKS))


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for n, x, y, fold in zip(*[batch.column(c).to_pylist() for c in ("n", "x", "y", "fold")]):
            yield np.frombuffer(x).reshape(n, -1), np.frombuffer(y), np.frombuffer(fold, np.int32)


def slot_sums(blocks: DataFrame, work: Work, read: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]] = unpacked) -> DataFrame:
    """(slot, sums): the vectors that work gives of each block's (x, y, fold), or of what `read` makes of blocks of another
    form, added up by slot, first in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for block in read(batches):
            for slot, vector in work(*block):
                total[slot] = total[slot] + vector if slot in total else vector
        for slot, vector in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int64()), pa.array([np.ravel(vector)], pa.list_(pa.float64()))], names=["slot", "sums"])

    parts = blocks.mapInArrow(run, "slot long, sums array<double>")
    return parts.groupBy("slot").agg(Summarizer.sum(array_to_vector("sums")).alias("sums"))


def collected_sums(blocks: DataFrame, work: Work) -> dict[int, np.ndarray]:
    """The sums on the driver, where the models are: a vector of a model's size per slot, whatever the number of rows."""
    return {r["slot"]: r["sums"].toArray() for r in slot_sums(blocks, work).collect()}
