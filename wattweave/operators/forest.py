"""Random forests grown in parts: large nodes level by level from sums over all rows, small ones whole, each by one task.

As MLlib grows them: every tree has a Poisson bag of the rows, every node tries `mtry` predictors at up to 31 borders, Gini
impurity, leaves of one row allowed, sibling leaves of one class merged, and leaves vote with their class shares. The
bag is drawn by a hash of tree and row, a node's predictors by a hash of tree and node, and all sums are whole numbers,
so the trees do not depend on which part of them was grown where.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattweave.operators.blocks import BLOCK_ROWS, slot_sums
from wattweave.operators.boosting import binned, quantile_borders
from wattweave.operators.knn import matrix
from wattweave.operators.models import class_labels, labelled
from wattweave.sources.shared import materialise

BINS = 32
LEAF = -1
#: A node with more rows (as often as they are in the bag) is split by sums over all tasks.
LOCAL_ROWS = 16_384
#: Nodes whose sums a task holds at once.
NODES_AT_ONCE = 500
#: Bytes of one batch of messages, of the messages that a partition is to get, and of the votes that a task holds.
BATCH_BYTES, PART_BYTES, HELD_BYTES = 4_000_000, 12_000_000, 32_000_000
LEAST_PARTS = 64
#: A leaf's shares are whole numbers of this unit: their sums have no rounding and no order.
ONE = float(1 << 32)
POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1.0, i + 1)) for i in range(16)])
ROWS = "first long, y binary, bins binary"
MESSAGES = "unit long, kind int, slot long, n int, y binary, weight binary, bins binary"
TREES = "unit long, nodes int, feature binary, cut binary, left binary, at binary, class binary, count binary"
SPLITS = "slot long, feature int, cut int, counts array<double>, below array<double>"


def hashed(seed: int, *parts) -> np.ndarray:
    h = np.zeros(1, np.uint64)
    for part in (seed, *parts):
        h = (h ^ np.asarray(part).astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h


def bag(seed: int, tree: int, rows: np.ndarray) -> np.ndarray:
    """How often each row, by its number, is in the tree's bag."""
    return np.searchsorted(POISSON, (hashed(seed, tree, rows) >> np.uint64(11)) * 2.0**-53, "right")


def predictors(seed: int, tree: int, nodes: np.ndarray, p: int, mtry: int) -> np.ndarray:
    """Nodes × mtry: the predictors that each node tries, in order."""
    if mtry >= p:
        return np.tile(np.arange(p), (len(nodes), 1))
    lots = hashed(seed, ~np.uint64(tree), np.asarray(nodes)[:, None], np.arange(p)[None])
    return np.sort(np.argpartition(lots, mtry - 1, axis=1)[:, :mtry], axis=1)


@dataclass
class Tree:
    """Nodes by level; `left` is the place of the left child, the right one follows it. Bins up to the cut go left."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    counts: np.ndarray

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf each row ends in."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            f = self.feature[at[rows]]
            inner = f != LEAF
            rows, f = rows[inner], f[inner]
            if not len(rows):
                return at
            here = at[rows]
            at[rows] = self.left[here] + (bins[rows, f] > self.cut[here])


def best_splits(value: np.ndarray, y: np.ndarray, weight: np.ndarray, at: np.ndarray, own: np.ndarray):
    """(tried predictor, cut) of every node of a level, the first of equals; predictor LEAF where no split gains.

    value: rows × tried predictors, at: each row's node, own: nodes × classes, the sums of the weights. Rows are sorted
    once by (predictor, node, bin) and once by (predictor, node, class), so that sums run along them.
    """
    n, tries = value.shape
    m, k = own.shape
    bits = int(n).bit_length()
    cells = (np.arange(tries)[:, None] * m + at) * BINS + value.T
    key = (cells << bits | np.arange(n)).ravel()
    key.sort()
    cell, row = key >> bits, key & ((1 << bits) - 1)
    group = cell // BINS
    node = group % m
    w, c = weight[row], y[row]
    start = np.flatnonzero(np.diff(group, prepend=-1))
    length = np.diff(np.append(start, len(group)))

    def running(v):
        total = np.cumsum(v)
        return total - np.repeat(total[start] - v[start], length)

    bits = int(len(key)).bit_length()
    by_class = (group * k + c) << bits | np.arange(len(key))
    by_class.sort()
    place, kind = by_class & ((1 << bits) - 1), by_class >> bits
    before = np.cumsum(w[place]) - w[place]
    first = np.flatnonzero(np.diff(kind, prepend=-1))
    same = np.empty(len(key), np.int64)
    same[place] = before - np.repeat(before[first], np.diff(np.append(first, len(kind))))

    left_n, left_squares, cross = running(w), running(w * (2 * same + w)), running(w * own[node, c])
    end = np.flatnonzero((np.diff(cell) != 0) & (np.diff(group) == 0))
    node, whole_n, whole_squares = node[end], own.sum(1), (own * own).sum(1)
    right_n = whole_n[node] - left_n[end]
    right_squares = whole_squares[node] - 2 * cross[end] + left_squares[end]
    score = left_squares[end] / left_n[end] + right_squares / right_n
    most = np.full(m, -np.inf)
    np.maximum.at(most, node, score)
    hit = np.flatnonzero(score == most[node])[::-1]
    chosen = np.full(m, LEAF)
    chosen[node[hit]] = hit  # the first of equals is written last
    gains = np.flatnonzero((chosen != LEAF) & (most > whole_squares / whole_n + 1e-9))
    tried, cut = np.full(m, LEAF), np.zeros(m, np.int64)
    tried[gains], cut[gains] = group[end[chosen[gains]]] // m, cell[end[chosen[gains]]] % BINS
    return tried, cut


def best_of_sums(sums: np.ndarray) -> tuple[int, int]:
    """The same of one node, given its weights by predictor, bin and class."""
    left = np.cumsum(sums, 1)[:, :-1]
    own = sums[0].sum(0)
    right = own - left
    left_n, right_n = left.sum(2), right.sum(2)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (left * left).sum(2) / left_n + (right * right).sum(2) / right_n
    score = np.where((left_n > 0) & (right_n > 0), score, -np.inf)
    at = int(np.argmax(score))
    return divmod(at, score.shape[1]) if score.flat[at] > (own * own).sum() / own.sum() + 1e-9 else (LEAF, 0)


def grow(bins: np.ndarray, y: np.ndarray, weight: np.ndarray, classes: int, tree: int, node: int, mtry: int, depth: int,
         seed: int) -> Tree:
    """The part of a tree below a node (0 the root, children of i: 2i + 1 and 2i + 2), whose rows are given."""
    heap, level = np.array([node], np.int64), (node + 1).bit_length() - 1
    rows, at = np.arange(len(bins)), np.zeros(len(bins), np.int64)
    levels, total = [], 0
    while len(heap):
        m = len(heap)
        own = np.rint(np.bincount(at * classes + y[rows], weight[rows], m * classes)).astype(np.int64).reshape(m, classes)
        feature, cut, left = np.full(m, LEAF), np.zeros(m, np.int64), np.full(m, LEAF)
        mixed = np.flatnonzero((own > 0).sum(1) > 1) if level < depth else np.zeros(0, np.int64)
        if len(mixed):
            place = np.full(m, LEAF)
            place[mixed] = np.arange(len(mixed))
            keep = place[at] != LEAF
            rows, at = rows[keep], place[at[keep]]
            some = predictors(seed, tree, heap[mixed], bins.shape[1], mtry)
            tried, cuts = best_splits(bins[rows[:, None], some[at]], y[rows], weight[rows], at, own[mixed])
            split = np.flatnonzero(tried != LEAF)
            feature[mixed[split]], cut[mixed[split]] = some[split, tried[split]], cuts[split]
            place = np.full(len(mixed), LEAF)
            place[split] = np.arange(len(split))
            keep = place[at] != LEAF
            rows, at = rows[keep], at[keep]
            at = 2 * place[at] + (bins[rows, feature[mixed[at]]] > cut[mixed[at]])
        inner = np.flatnonzero(feature != LEAF)
        left[inner] = total + m + 2 * np.arange(len(inner))
        levels.append((feature, cut, left, own))
        total += m
        heap = (2 * heap[inner][:, None] + np.array([1, 2])).ravel()
        level += 1
    return pruned(Tree(*[np.concatenate(x) for x in zip(*levels)]), [len(x[0]) for x in levels])


def pruned(tree: Tree, sizes: list[int]) -> Tree:
    """Sibling leaves of the same class become one leaf, from the lowest level up. sizes: nodes of each level."""
    best, ends = tree.counts.argmax(1), np.cumsum(sizes)
    for a, b in zip((ends - sizes)[::-1], ends[::-1]):
        inner = a + np.flatnonzero(tree.feature[a:b] != LEAF)
        child = tree.left[inner]
        merged = (tree.feature[child] == LEAF) & (tree.feature[child + 1] == LEAF) & (best[child] == best[child + 1])
        tree.feature[inner[merged]] = LEAF
    reached = np.zeros(len(best), bool)
    reached[0] = True
    for a, b in zip(ends - sizes, ends):
        inner = a + np.flatnonzero(reached[a:b] & (tree.feature[a:b] != LEAF))
        reached[tree.left[inner]] = reached[tree.left[inner] + 1] = True
    number = np.cumsum(reached) - 1
    left = np.where(tree.feature != LEAF, number[tree.left], LEAF)
    return Tree(tree.feature[reached], tree.cut[reached], left[reached], tree.counts[reached])


@dataclass
class Top:
    """The part of a tree whose nodes were split by sums over all rows; it grows on the driver, which has no rows.

    `open` nodes wait for their sums, `units` are grown by one task, and `leaves` have their class counts here."""

    feature: list[int] = field(default_factory=lambda: [LEAF])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [LEAF])
    heap: list[int] = field(default_factory=lambda: [0])
    open: set[int] = field(default_factory=set)
    units: set[int] = field(default_factory=set)
    leaves: dict[int, np.ndarray] = field(default_factory=dict)

    def tree(self) -> Tree:
        return Tree(np.array(self.feature), np.array(self.cut), np.array(self.left), np.zeros(0))

    def split(self, at: int, feature: int, cut: int, counts: np.ndarray, below: np.ndarray, depth: int, local_rows: int) -> None:
        self.open.remove(at)
        if feature == LEAF:
            self.leaves[at] = counts
            return
        self.feature[at], self.cut[at], self.left[at] = feature, cut, len(self.feature)
        for side, own in ((1, below), (2, counts - below)):
            child, heap = len(self.feature), 2 * self.heap[at] + side
            for values, v in ((self.feature, LEAF), (self.cut, 0), (self.left, LEAF), (self.heap, heap)):
                values.append(v)
            if (heap + 1).bit_length() - 1 >= depth or (own > 0).sum() < 2:
                self.leaves[child] = own
            elif own.sum() <= local_rows:
                self.units.add(child)
            else:
                self.open.add(child)

    def prune(self, single: dict[int, np.ndarray]) -> None:
        """As `pruned`; single: the counts of the units that are one leaf."""
        ends = {**self.leaves, **single}
        for at in reversed(range(len(self.feature))):
            if self.feature[at] != LEAF:
                own, other = ends.get(self.left[at]), ends.get(self.left[at] + 1)
                if own is not None and other is not None and own.argmax() == other.argmax():
                    ends[at] = self.leaves[at] = own + other
                    self.feature[at] = self.left[at] = LEAF


def split_borders(df: DataFrame, features: str) -> list[np.ndarray]:
    """Up to 31 borders of each predictor: between all its values if there are few, else quantiles."""
    values = df.select(F.posexplode(features).alias("pos", "v"))
    borders = list(quantile_borders(df, BINS, features))
    distinct = values.groupBy("pos").agg(F.approx_count_distinct("v").alias("n")).collect()
    few = [r["pos"] for r in distinct if r["n"] <= 2 * BINS]
    if few:
        for r in values.where(F.col("pos").isin(few)).groupBy("pos").agg(F.sort_array(F.collect_set("v")).alias("v")).collect():
            if len(r["v"]) <= BINS:
                v = np.array(r["v"], float)
                borders[r["pos"]] = (v[:-1] + v[1:]) / 2
    return borders


def packed_rows(df: DataFrame, borders: list[np.ndarray]) -> DataFrame:
    """Rows (x, y) as stored blocks of bins; `first` is the number of a block's first row."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_ROWS):
                b = batch.slice(a, BLOCK_ROWS)
                parts = [b.column("y").to_numpy(zero_copy_only=False).astype(np.int64), binned(matrix(b.column("x")), borders)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([first], pa.int64()), *[pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in parts]], names=["first", "y", "bins"])
                first += b.num_rows

    return materialise(df.mapInArrow(pack, ROWS))


def read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for batch in batches:
        for first, y, bins in zip(*[batch.column(c).to_pylist() for c in ("first", "y", "bins")]):
            y = np.frombuffer(y, np.int64)
            yield first, y, np.frombuffer(bins, np.uint8).reshape(len(y), -1)


def by_place(at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(place, rows) for each place."""
    order = np.argsort(at, kind="stable")
    start = np.flatnonzero(np.diff(at[order], prepend=-1))
    for a, b in zip(start, [*start[1:], len(order)]):
        yield int(at[order[a]]), order[a:b]


def batched(rows: Iterator[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    run, total = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*run), schema)], schema=schema)

    for row in rows:
        run.append(row)
        total += size(row)
        if total >= BATCH_BYTES:
            yield batch()
            run, total = [], 0
    if run:
        yield batch()


def arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split(" ") for f in schema.split(", "))])


def tree_row(unit: int, tree: Tree) -> tuple:
    leaf = np.flatnonzero(tree.feature == LEAF)
    at, kind = np.nonzero(tree.counts[leaf])
    columns = ((tree.feature, np.int16), (tree.cut, np.uint8), (tree.left, np.int32), (leaf[at], np.int32), (kind, np.int32),
               (tree.counts[leaf][at, kind], np.int64))
    return unit, len(tree.feature), *[v.astype(t).tobytes() for v, t in columns]


def shares(feature: bytes, cut: bytes, left: bytes, at: bytes, kind: bytes, count: bytes, classes: int) -> tuple[Tree, np.ndarray]:
    """A stored part of a tree and the votes of its leaves."""
    f = np.frombuffer(feature, np.int16)
    counts = np.zeros((len(f), classes))
    counts[np.frombuffer(at, np.int32), np.frombuffer(kind, np.int32)] = np.frombuffer(count, np.int64)
    votes = np.rint(counts / np.maximum(counts.sum(1, keepdims=True), 1) * ONE)
    return Tree(f, np.frombuffer(cut, np.uint8), np.frombuffer(left, np.int32), counts), votes


def parts_for(rows: int, trees: int, width: int) -> int:
    return max(LEAST_PARTS, -(-rows * trees * width // PART_BYTES))


@dataclass
class ForestModel:
    """`tops` are the parts near the roots, `trees` the parts below them, a row each; these stay with the executors."""

    classes: list[str]
    borders: list[np.ndarray]
    tops: list[Tree]
    trees: DataFrame

    def transform(self, df: DataFrame, features: str = "features", prediction: str = "predicted") -> DataFrame:
        """Add the predicted class and its share of the votes; both are null where features are. No row is lost.

        Rows travel to the parts of trees that they end in, votes come back as sums a block of rows.
        """
        classes, borders, tops, p, k = self.classes, self.borders, self.tops, len(self.borders), len(self.classes)
        numbered = materialise(df.withColumn("__row", F.monotonically_increasing_id()))
        whole = numbered.where(F.col(features).isNotNull()).select(
            F.col(features).cast("array<double>").alias("x"), F.col("__row").alias("y"))
        blocks = packed_rows(whole, borders)

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def messages():
                for first, ids, bins in read_rows(batches):
                    for t, top in enumerate(tops):
                        for place, rows in by_place(top.nodes(bins)):
                            yield t << 32 | place, 1, first, len(ids), rows.astype(np.int32).tobytes(), None, bins[rows].tobytes()

            yield from batched(messages(), arrow(MESSAGES), lambda r: len(r[6]))

        def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("slot", pa.int64()), ("sums", pa.list_(pa.float64()))])
            held: dict[int, np.ndarray] = {}
            unit, tree, votes = None, None, None

            def given():
                for slot, sums in held.items():
                    yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int64()), pa.array([sums.ravel()], pa.list_(pa.float64()))], schema=schema)
                held.clear()

            for batch in batches:
                for r in range(batch.num_rows):
                    row = {name: batch.column(name)[r].as_py() for name in batch.schema.names}
                    if row["kind"] == 0:
                        unit = row["unit"]
                        tree, votes = shares(*[row[c] for c in ("feature", "cut", "left", "at", "class", "count")], k)
                        continue
                    if row["unit"] != unit:
                        raise RuntimeError("a part of a tree is missing")
                    rows = np.frombuffer(row["y"], np.int32)
                    if row["slot"] not in held:
                        if sum(v.nbytes for v in held.values()) >= HELD_BYTES:
                            yield from given()
                        held[row["slot"]] = np.zeros((row["n"], k))
                    held[row["slot"]][rows] += votes[tree.nodes(np.frombuffer(row["bins"], np.uint8).reshape(-1, p))]
            yield from given()

        def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, sums in zip(batch.column("y").to_pylist(), batch.column("sums").to_pylist()):
                    votes = np.rint(sums).reshape(-1, k)
                    best = votes.argmax(1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.frombuffer(ids, np.int64)), pa.array([classes[i] for i in best], pa.string()),
                         pa.array(votes[np.arange(len(best)), best] / votes.sum(1))], names=["__row", prediction, "probability"])

        sent = blocks.mapInArrow(send, MESSAGES)
        met = sent.unionByName(self.trees.withColumn("kind", F.lit(0)), allowMissingColumns=True)
        parts = parts_for(whole.count(), len(tops), p + 4)
        met = met.repartition(parts, "unit").sortWithinPartitions("unit", "kind")
        sums = met.mapInArrow(vote, "slot long, sums array<double>").groupBy("slot").agg(
            Summarizer.sum(array_to_vector("sums")).alias("sums")).select("slot", vector_to_array("sums").alias("sums"))
        named = blocks.join(sums, F.col("first") == F.col("slot")).select("y", "sums").mapInArrow(
            name, f"__row long, `{prediction}` string, probability double")
        return numbered.join(named, "__row", "left").drop("__row")


def fit_forest(df: DataFrame, label: str, mtry: int, trees: int = 500, depth: int = 20, seed: int = 100,
               features: str = "features", local_rows: int = LOCAL_ROWS) -> ForestModel:
    """Trees over the rows that have a label and features.

    While a node has more than local_rows rows, its level is one job: tasks add up the weights by tried predictor, bin and
    class, executors find each node's split, and only splits and class counts come to the driver. The rows of each
    smaller node then travel to one task, which grows the rest. local_rows steers cost and memory, never the trees.
    """
    rows = labelled(df, label).where(F.col(features).isNotNull())
    classes = class_labels(rows, label)
    if not classes:
        raise ValueError("there are no rows to learn from")
    k, borders = len(classes), split_borders(rows, features)
    p = len(borders)
    mtry = min(mtry, p)
    place = F.array_position(F.array(*map(F.lit, classes)), F.col(label).cast("string")) - 1
    blocks = packed_rows(rows.select(F.col(features).cast("array<double>").alias("x"), place.alias("y")), borders)
    n = sum(r[0] for r in blocks.select((F.octet_length("y") / 8).cast("long").alias("n")).groupBy().sum("n").collect())
    tops = [Top(open={0}) if n > local_rows else Top(units={0}) for _ in range(trees)]

    while any(top.open for top in tops):
        waiting = [(t, at) for t, top in enumerate(tops) for at in sorted(top.open)]
        for a in range(0, len(waiting), NODES_AT_ONCE):
            some: dict[int, list[int]] = {}
            for t, at in waiting[a : a + NODES_AT_ONCE]:
                some.setdefault(t, []).append(at)
            level = {t: (tops[t].tree(), at, predictors(seed, t, np.array([tops[t].heap[i] for i in at]), p, mtry)) for t, at in some.items()}
            tried = {t << 32 | i: choice[j] for t, (_, at, choice) in level.items() for j, i in enumerate(at)}

            def weights(first, y, bins, level=level):
                for t, (tree, at, choice) in level.items():
                    weight, node = bag(seed, t, first + np.arange(len(y))), tree.nodes(bins)
                    for i, own in zip(at, choice):
                        here = np.flatnonzero((node == i) & (weight > 0))
                        if len(here):
                            cell = ((np.arange(mtry) * BINS + bins[here][:, own]) * k + y[here][:, None]).ravel()
                            yield t << 32 | i, np.bincount(cell, np.repeat(weight[here], mtry), mtry * BINS * k)

            def choose(batches: Iterator[pa.RecordBatch], tried=tried) -> Iterator[pa.RecordBatch]:
                def found():
                    for b in batches:
                        for slot, sums in zip(b.column("slot").to_pylist(), b.column("sums").to_pylist()):
                            sums = np.rint(sums).reshape(mtry, BINS, k)  # the summarizer takes means on its way
                            of, cut = best_of_sums(sums)
                            yield slot, LEAF if of == LEAF else int(tried[slot][of]), cut, sums[0].sum(0), sums[of, : cut + 1].sum(0)

                yield from batched(found(), arrow(SPLITS), lambda r: 16 * k)

            sums = slot_sums(blocks, weights, read_rows).select("slot", vector_to_array("sums").alias("sums"))
            for slot, feature, cut, counts, below in sums.mapInArrow(choose, SPLITS).collect():
                tops[slot >> 32].split(slot & 0xFFFFFFFF, feature, cut, np.array(counts), np.array(below), depth, local_rows)

    routes = [(top.tree(), top.units, top.heap) for top in tops]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def messages():
            for first, y, bins in read_rows(batches):
                for t, (top, units, _) in enumerate(routes):
                    weight = bag(seed, t, first + np.arange(len(y)))
                    drawn = np.flatnonzero(weight)
                    for at, some in by_place(top.nodes(bins[drawn])):
                        if at in units:
                            own = drawn[some]
                            yield t << 32 | at, 1, first, len(own), y[own].astype(np.int32).tobytes(), weight[own].astype(np.uint8).tobytes(), bins[own].tobytes()

        yield from batched(messages(), arrow(MESSAGES), lambda r: len(r[6]))

    def grown(table: pa.Table) -> pa.Table:
        unit = table.column("unit")[0].as_py()
        y, weight, bins = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("y", np.int32), ("weight", np.uint8), ("bins", np.uint8)))
        t, at = unit >> 32, unit & 0xFFFFFFFF
        tree = grow(bins.reshape(len(y), -1), y.astype(np.int64), weight.astype(np.int64), k, t, routes[t][2][at], mtry, depth, seed)
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(tree_row(unit, tree), arrow(TREES))], schema=arrow(TREES))

    sent = blocks.mapInArrow(send, MESSAGES).repartition(parts_for(n, trees, p + 5), "unit")
    below = materialise(sent.groupBy("unit").applyInArrow(grown, TREES))

    if n > local_rows:
        single: list[dict[int, np.ndarray]] = [{} for _ in tops]
        for r in below.where("nodes = 1").select("unit", "class", "count").collect():
            counts = np.zeros(k)
            counts[np.frombuffer(r["class"], np.int32)] = np.frombuffer(r["count"], np.int64)
            single[r["unit"] >> 32][r["unit"] & 0xFFFFFFFF] = counts
        for top, own in zip(tops, single):
            top.prune(own)
    leaves = [tree_row(t << 32 | at, Tree(np.array([LEAF]), np.zeros(1), np.array([LEAF]), counts.reshape(1, -1)))
              for t, top in enumerate(tops) for at, counts in top.leaves.items()]
    if leaves:
        below = below.unionAll(df.sparkSession.createDataFrame(leaves, TREES.replace(", class", ", `class`")))
    return ForestModel(classes, borders, [top.tree() for top in tops], below)
