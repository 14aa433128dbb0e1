"""Exact nearest neighbours without a cross join, by a metric tree.

Corpus rows are dealt to the nearest of a node's pivots, level by level, until a cell is small. A query first goes down
to its own cell; the k nearest pivots on its way and the rows of its cell give a distance within which all its k nearest
rows lie. Then it visits only the cells which that distance reaches: those that the triangle inequality cannot rule out,
by the cell's least and largest distance from its pivot and by the border between two pivots. Neither pivots nor cells
come to the driver, so their number may grow with the data.

Rows meet pivots, and queries the rows of a cell, in blocks of bounded size; a block returns per query the distances of
its k nearest rows, never the pairs, and partial results are merged. Equal corpus rows are counted together first, so a
large group of copies is one row. In many dimensions few cells can be ruled out; results stay exact, at more work.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from wattweave.functions.vectors import euclidean
from wattweave.sources.shared import materialise


@dataclass(frozen=True)
class Sizes:
    """Row counts that bound what a task holds; they steer cost and memory, never the result."""

    cell_rows: int = 250_000
    fan: int = 16
    levels: int = 9
    query_rows: int = 32_768
    corpus_rows: int = 32_768


#: A side with few rows is dealt into blocks of so many rows, this number of blocks at most, so that several tasks share it.
LEAST_ROWS, LEAST_BLOCKS = 2_048, 4
#: Distances that a block's search holds at once.
HELD_GAPS = 1 << 22


ROOT = 1
#: Relative room for the rounding of distances, so that no cell is ruled out by it.
ROOM = 1e-9


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows × positions from a list column without nulls."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1)


def squared_gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b, up to rounding."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T), 0.0)


def exact_gaps(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots by differences: a bound must not have the rounding of the product form."""
    out = np.empty((len(rows), len(pivots)))
    for at, pivot in enumerate(pivots):
        gap = rows - pivot
        out[:, at] = np.sqrt((gap * gap).sum(1))
    return out


def nearest(queries: DataFrame, corpus: DataFrame, key: str, k: int, value: str | None = None,
            sizes: Sizes = Sizes()) -> DataFrame:
    """The k nearest corpus rows of every query, ties at the k-th distance included.

    Both sides carry ``features`` (complete arrays of one length). Returns one row per query and distinct
    distance: (key, distance, n, total), where n counts the corpus rows at that distance and total sums ``value``.
    """
    return Tree.build(corpus, value, sizes).search(queries, key, k)


@dataclass
class Tree:
    """Distinct corpus rows with their cell, and for each level the pivots: (node, child, pivot, inner, outer, leaf).

    A node's children are ``node * fan`` and up, so ids are unique over the levels. A cell that is still large at the
    last level is a leaf all the same and is searched in blocks.
    """

    points: DataFrame
    levels: list[DataFrame]
    sizes: Sizes
    met: list[DataFrame] = field(default_factory=list)

    @classmethod
    def build(cls, corpus: DataFrame, value: str | None = None, sizes: Sizes = Sizes()) -> Tree:
        summed = F.sum(F.col(value).cast("double")) if value else F.lit(0.0)
        rows = materialise(corpus.groupBy("features").agg(F.count(F.lit(1)).alias("n"), summed.alias("total"))
                           .withColumn("node", F.lit(ROOT).cast("long")))
        held, levels = [], []
        many = rows.count() > sizes.cell_rows
        while many and len(levels) < sizes.levels:
            slot = F.pmod(F.xxhash64("features"), sizes.fan)
            least = F.min(F.struct(F.xxhash64(F.lit(len(levels)), "features").alias("h"), "features"))
            pivots = materialise(rows.groupBy("node", slot.alias("slot")).agg(least.alias("least")).select(
                "node", (F.col("node") * sizes.fan + F.col("slot")).alias("child"), F.col("least.features").alias("pivot")))
            columns = "features array<double>, n long, total double, node long, gap double"
            placed = materialise(_meet(rows, pivots, _place, columns, F.xxhash64("features"), sizes.corpus_rows, sizes.fan)[0])
            cells = placed.groupBy(F.col("node").alias("child")).agg(
                F.count(F.lit(1)).alias("rows"), F.min("gap").alias("inner"), F.max("gap").alias("outer"))
            last = len(levels) + 1 == sizes.levels
            leaf = F.lit(True) if last else F.col("rows") <= sizes.cell_rows
            level = materialise(pivots.join(cells, "child").select("node", "child", "pivot", "inner", "outer", leaf.alias("leaf")))
            levels.append(level)
            leaves = level.select(F.col("child").alias("node"), "leaf")
            marked = placed.drop("gap").join(leaves, "node")
            held.append(marked.where("leaf").drop("leaf"))
            rows = marked.where("not leaf").drop("leaf")
            many = not level.where("not leaf").isEmpty()
        points = materialise(reduce(DataFrame.unionByName, held)) if held else rows
        return cls(points, levels, sizes)

    def search(self, queries: DataFrame, key: str, k: int) -> DataFrame:
        """What ``nearest`` returns; ``met`` then has the numbers of queries and rows that met, by cell."""
        at_root = (F.lit(ROOT).cast("long").alias("node"), F.lit(float("inf")).alias("bound"))
        asked = materialise(queries.select(F.col(key).alias("key"), "features", *at_root))
        name = asked.schema["key"].dataType.simpleString()
        columns = f"key {name}, features array<double>, node long, bound double"
        own = self._down(asked, columns, k)
        parts = [self._look(own, k, name)]
        if self.levels:
            parts[0] = materialise(parts[0])
            running = Window.partitionBy("key").orderBy("distance")
            within = (parts[0].groupBy("key", "distance").agg(F.sum("n").alias("n"))
                      .withColumn("upto", F.sum("n").over(running)).where(F.col("upto") >= k)
                      .groupBy(F.col("key").alias("_key")).agg(F.min("distance").alias("within")))
            bounded = own.join(within, F.col("key").eqNullSafe(F.col("_key")), "left").select(
                "key", "features", F.lit(ROOT).cast("long").alias("node"), F.least("bound", "within").alias("bound"),
                F.col("node").alias("own"))
            parts.append(self._look(self._reached(materialise(bounded), columns), k, name))
        partial = reduce(DataFrame.unionAll, parts)
        merged = partial.groupBy("key", "distance").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        before = Window.partitionBy("key").orderBy("distance").rowsBetween(Window.unboundedPreceding, -1)
        return (merged.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
                .where(F.col("before") < k).select(F.col("key").alias(key), "distance", "n", "total"))

    def _down(self, asked: DataFrame, columns: str, k: int) -> DataFrame:
        """Queries in their own cell, each with a first bound from the pivots it met: pivots are corpus rows."""
        ended = []
        for level in self.levels:
            step = _meet(asked, level, _descend(k), f"{columns}, leaf boolean", F.xxhash64("key"), self.sizes.query_rows, self.sizes.fan)[0]
            step = materialise(step)
            ended.append(step.where("leaf").drop("leaf"))
            asked = step.where("not leaf").drop("leaf")
        return reduce(DataFrame.unionByName, ended) if ended else asked

    def _reached(self, asked: DataFrame, columns: str) -> DataFrame:
        """Queries with each cell but their own that may hold a row within their bound."""
        ended = []
        for level in self.levels:
            step = _meet(asked, level, _prune, f"{columns}, own long, leaf boolean", F.xxhash64("key"), self.sizes.query_rows, self.sizes.fan)[0]
            step = materialise(step)
            ended.append(step.where("leaf and node <> own").drop("leaf", "own"))
            asked = step.where("not leaf").drop("leaf")
        return reduce(DataFrame.unionByName, ended)

    def _look(self, asked: DataFrame, k: int, name: str) -> DataFrame:
        found, layout = _meet(asked, self.points, _block_search(k), f"key {name}, distance double, n long, total double",
                              F.xxhash64("key"), self.sizes.query_rows, self.sizes.corpus_rows)
        self.met.append(layout)
        return found


def _meet(left: DataFrame, right: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], columns: str, by: Column,
          left_rows: int, right_rows: int) -> tuple[DataFrame, DataFrame]:
    """work(left, right) on blocks of rows that share a node, and the numbers of rows by node.

    Left rows are dealt by ``by``, right rows by all their columns; a block has about so many rows of each side.
    """
    sides = [df.groupBy("node").agg(F.count(F.lit(1)).alias(name)) for df, name in ((left, "asked"), (right, "rows"))]
    layout = sides[0].join(sides[1], "node")
    shared = F.least(F.ceil(F.col("asked") / min(LEAST_ROWS, left_rows)), F.lit(LEAST_BLOCKS))
    parts = layout.select("node", F.greatest(F.ceil(F.col("asked") / left_rows), shared).alias("left_parts"),
                          F.ceil(F.col("rows") / right_rows).alias("right_parts"))
    block = ["node", "left_part", "right_part"]
    nothing = to_arrow_schema(StructType.fromDDL(columns)).empty_table()

    def both(one: pa.Table, other: pa.Table) -> pa.Table:
        return work(one, other) if one.num_rows and other.num_rows else nothing

    def dealt(df, own, hashed, other):
        spread = df.withColumn("_hash", hashed).join(parts, "node")
        return spread.select(*df.columns, F.pmod("_hash", F.col(f"{own}_parts")).alias(f"{own}_part"),
                             F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_parts") - 1)).alias(f"{other}_part"))

    one = dealt(left, "left", by, "right")
    two = dealt(right, "right", F.xxhash64(*right.columns), "left")
    two = two.select(*[F.col(c).alias(c) for c in two.columns])  # both sides may descend from one frame
    return one.groupBy(*block).cogroup(two.groupBy(*block)).applyInArrow(both, columns), layout


def _place(left: pa.Table, right: pa.Table) -> pa.Table:
    """Corpus rows in the cell of their nearest pivot."""
    gaps = exact_gaps(matrix(left.column("features")), matrix(right.column("pivot")))
    best = gaps.argmin(1)
    return pa.table({**{c: left.column(c) for c in ("features", "n", "total")},
                     "node": right.column("child").to_numpy()[best], "gap": gaps[np.arange(len(best)), best]})


def _descend(k: int):
    def step(left: pa.Table, right: pa.Table) -> pa.Table:
        gaps = exact_gaps(matrix(left.column("features")), matrix(right.column("pivot")))
        best, bound = gaps.argmin(1), left.column("bound").to_numpy()
        if gaps.shape[1] >= k:
            bound = np.minimum(bound, np.partition(gaps, k - 1, axis=1)[:, k - 1])
        return pa.table({"key": left.column("key"), "features": left.column("features"),
                         "node": right.column("child").to_numpy()[best], "bound": bound,
                         "leaf": right.column("leaf").to_numpy()[best]})

    return step


def _prune(left: pa.Table, right: pa.Table) -> pa.Table:
    """Queries with each child that can hold a row within their bound."""
    gaps = exact_gaps(matrix(left.column("features")), matrix(right.column("pivot")))
    inner, outer = right.column("inner").to_numpy(), right.column("outer").to_numpy()
    bound = left.column("bound").to_numpy()[:, None]
    room = ROOM * (gaps + outer + np.where(np.isfinite(bound), bound, 0.0))
    reached = (gaps - outer <= bound + room) & (inner - gaps <= bound + room)
    reached &= gaps - gaps.min(axis=1, keepdims=True) <= 2 * bound + room
    rows, children = np.nonzero(reached)
    kept = left.select(["key", "features", "bound", "own"]).take(pa.array(rows))
    return pa.table({"key": kept.column("key"), "features": kept.column("features"),
                     "node": right.column("child").to_numpy()[children], "bound": kept.column("bound"),
                     "own": kept.column("own"), "leaf": right.column("leaf").to_numpy()[children]})


def _block_search(k: int):
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, distances, counts, totals = [], [], [], []
        asked, points = matrix(left.column("features")), matrix(right.column("features"))
        n, total = right.column("n").to_numpy(), right.column("total").to_numpy()
        ids, bounds = left.column("key").to_pylist(), left.column("bound").to_numpy() * (1 + ROOM)
        kth = min(k, len(points)) - 1
        norm = (points * points).sum(1).max()
        held = max(1, min(256, HELD_GAPS // len(points)))
        for start in range(0, len(asked), held):
            some = asked[start:start + held]
            rough = squared_gaps(some, points)
            # wide enough for the rounding of the product form; exact distances decide below
            limit = np.partition(rough, kth, axis=1)[:, kth] + 1e-9 * ((some * some).sum(1) + norm)
            for row, query in enumerate(some):
                hits = np.flatnonzero(rough[row] <= limit[row])
                gaps = points[hits] - query
                exact = np.sqrt((gaps * gaps).sum(1))
                levels, level = np.unique(exact, return_inverse=True)
                at = np.bincount(level, n[hits]).astype(np.int64)
                of = np.bincount(level, total[hits])
                keep = (np.cumsum(at) - at < k) & (levels <= bounds[start + row])
                keys += [ids[start + row]] * int(keep.sum())
                distances.append(levels[keep])
                counts.append(at[keep])
                totals.append(of[keep])
        flat = [np.concatenate(x) for x in (distances, counts, totals)]
        return pa.table({"key": pa.array(keys, left.schema.field("key").type), "distance": pa.array(flat[0]),
                         "n": pa.array(flat[1].astype(np.int64)), "total": pa.array(flat[2])})

    return search


@dataclass(frozen=True)
class Scaler:
    """Centre and scale per array position."""

    mean: list[float]
    sd: list[float]

    def apply(self, features) -> Column:
        centred = F.zip_with(F.col(features), F.lit(self.mean), lambda x, m: x - m)
        return F.zip_with(centred, F.lit(self.sd), lambda x, s: x / s)


def fit_scaler(df: DataFrame, features: str = "features") -> Scaler:
    """Mean and sample sd per position; a constant position keeps scale one."""
    stats = df.select(Summarizer.metrics("mean", "std").summary(array_to_vector(features)).alias("s")).first()["s"]
    return Scaler([float(v) for v in stats["mean"]], [float(v) or 1.0 for v in stats["std"]])


def knn_regress(train: DataFrame, test: DataFrame, key: str, target: str, k: int = 9,
                sizes: Sizes = Sizes()) -> DataFrame:
    """Mean target of the k nearest training rows on centred and scaled features: (key, estimate, neighbours)."""
    scaler = fit_scaler(train)
    scaled = [df.withColumn("features", scaler.apply("features")) for df in (test, train)]
    found = nearest(*scaled, key, k, target, sizes)
    return found.groupBy(key).agg((F.sum("total") / F.sum("n")).alias("estimate"), F.sum("n").alias("neighbours"))


def nearest_distance(df: DataFrame, key: str, k: int = 1, sizes: Sizes = Sizes()) -> DataFrame:
    """Distance of every row to its k-th nearest other row: (key, distance)."""
    found = nearest(df, df, key, k + 1, sizes=sizes)  # a row is its own first neighbour
    running = Window.partitionBy(key).orderBy("distance").rowsBetween(Window.unboundedPreceding, 0)
    reached = found.withColumn("upto", F.sum("n").over(running) - 1)
    return reached.where(F.col("upto") >= k).groupBy(key).agg(F.min("distance").alias("distance"))


def paired_distance(pairs: DataFrame, rows: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Distances of listed pairs of rows, with missing positions left out and scaled for."""
    a = rows.select(F.col(key).alias(left), F.col("features").alias("_a"))
    b = rows.select(F.col(key).alias(right), F.col("features").alias("_b"))
    return pairs.join(a, left).join(b, right).withColumn("distance", euclidean("_a", "_b")).drop("_a", "_b")
