"""Multi-class boosting: second-order trees on quantile bins, the trees of all classes grown by one aggregation a level."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattweave.operators.blocks import BLOCKS, slot_sums, to_blocks, unpacked
from wattweave.operators.knn import matrix
from wattweave.operators.models import class_labels, labelled
from wattweave.sources.shared import materialise

BINS = 64
BAKE = 10
NO_SPLIT = -1


@dataclass
class Tree:
    """Nodes in heap order: node i has children 2i + 1 and 2i + 2; `feature` is NO_SPLIT in a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return Tree(np.full(n, NO_SPLIT), np.zeros(n, int), np.zeros(n))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node each row ends in: bins up to the cut go left."""
        at = np.zeros(len(bins), int)
        while True:
            f = self.feature[at]
            inner = np.flatnonzero(f != NO_SPLIT)
            if not len(inner):
                return at
            at[inner] = 2 * at[inner] + 1 + (bins[inner, f[inner]] > self.cut[at[inner]])


@dataclass
class BoostedModel:
    classes: list[str]
    borders: np.ndarray
    rounds: list[list[Tree]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return binned(x, self.borders)

    def transform(self, df: DataFrame, features: str = "features", prediction: str = "predicted") -> DataFrame:
        """Add the predicted class and its probability."""
        model = self

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    share = softmax(margins(model.bins(matrix(batch.column(features))), model.rounds, len(model.classes)))
                    best = share.argmax(1)
                    yield pa.RecordBatch.from_arrays(
                        [*batch.columns, pa.array([model.classes[i] for i in best], pa.string()), pa.array(share[np.arange(len(best)), best])],
                        [*batch.schema.names, prediction, "probability"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        return df.mapInArrow(score, f"{fields}, `{prediction}` string, probability double")


def binned(x: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Number of borders below each value, per feature."""
    return np.stack([np.searchsorted(borders[j], x[:, j], "left") for j in range(x.shape[1])], 1).astype(np.uint8)


def margins(bins: np.ndarray, rounds: list[list[Tree]], classes: int) -> np.ndarray:
    out = np.zeros((len(bins), classes))
    for trees in rounds:
        for c, tree in enumerate(trees):
            out[:, c] += tree.value[tree.nodes(bins)]
    return out


def softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def quantile_borders(df: DataFrame, bins: int, features: str) -> np.ndarray:
    """bins - 1 quantiles of each feature, from a sketch that is merged by the executors; equal ones stay, unused."""
    shares = [(i + 1) / bins for i in range(bins - 1)]
    rows = df.select(F.posexplode(features).alias("pos", "v")).groupBy("pos").agg(
        F.percentile_approx("v", shares, 10_000).alias("q")).orderBy("pos").collect()
    return np.array([r["q"] for r in rows], float).reshape(len(rows), bins - 1)


def best_split(g: np.ndarray, h: np.ndarray, ridge: float, least_weight: float, least_gain: float):
    """Best (gain, feature, cut) of histograms (features × bins), the first of equals; feature NO_SPLIT where none gains."""
    left_g, left_h = np.cumsum(g, 1)[:, :-1], np.cumsum(h, 1)[:, :-1]
    all_g, all_h = g[0].sum(), h[0].sum()
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - all_g**2 / (all_h + ridge)
    gain = np.where((left_h >= least_weight) & (right_h >= least_weight), gain, -np.inf)
    at = int(np.argmax(gain))
    f, cut = divmod(at, gain.shape[1])
    return (float(gain.flat[at]), f, cut) if gain.flat[at] > max(least_gain, 1e-9) else (0.0, NO_SPLIT, 0)


def fit_boosted(df: DataFrame, label: str, rounds: int = 150, depth: int = 8, rate: float = 0.3, ridge: float = 1.0,
                least_weight: float = 1.0, least_gain: float = 0.0, bins: int = BINS, features: str = "features") -> BoostedModel:
    """Softmax boosting. A level of a round is one job: tasks sum the slopes and curvatures of each open node of each
    class's tree by feature and bin, executors add them up and find each node's best split, and only the splits come
    to the driver. Every BAKE rounds the margins so far are written into the rows, so that a job walks few trees.
    Curvature is 2p(1 - p). Rows without a label are not learned from.
    """
    rows = labelled(df, label)
    classes = class_labels(rows, label)
    k = len(classes)
    borders = quantile_borders(rows, bins, features)
    model = BoostedModel(classes, borders)
    place = F.array_position(F.array(*map(F.lit, classes)), F.col(label).cast("string")) - 1
    blocks = with_margins(to_blocks(rows, features, place), borders, [], k)
    p, baked = len(borders), 0
    spans = p * bins

    for number in range(rounds):
        if number - baked == BAKE:
            blocks, baked = with_margins(blocks, borders, model.rounds[baked:], k), number
        trees, recent = [Tree.empty(depth) for _ in range(k)], model.rounds[baked:]
        open_nodes = {(c, 0) for c in range(k)}
        for level in range(depth + 1):
            if not open_nodes:
                break
            split = level < depth

            def slopes(x, y, fold, trees=trees, recent=recent, open_nodes=open_nodes, split=split):
                cells, kept = unbaked(x, p, k)
                share = softmax(kept + margins(cells, recent, k))
                slot_of_cell = np.arange(p) * bins + cells
                for c in range(k):
                    g = share[:, c] - (y == c)
                    h = np.maximum(2.0 * share[:, c] * (1.0 - share[:, c]), 1e-16)
                    node = trees[c].nodes(cells)
                    for own in {n for of, n in open_nodes if of == c}:
                        here = node == own
                        if here.any():
                            if split:
                                at = slot_of_cell[here].ravel()
                                sums = [np.bincount(at, np.repeat(v[here], p), spans) for v in (g, h)]
                            else:
                                sums = [np.array([v[here].sum()]) for v in (g, h)]
                            yield c << 32 | own, np.concatenate(sums)

            def choose(batches: Iterator[pa.RecordBatch], split=split) -> Iterator[pa.RecordBatch]:
                out = []
                for b in batches:
                    for slot, sums in zip(b.column("slot").to_pylist(), b.column("sums").to_pylist()):
                        g, h = np.array(sums).reshape(2, -1)
                        value = lambda s, t: -s / (t + ridge) * rate
                        if not split:
                            out.append((slot, NO_SPLIT, 0, value(g[0], h[0])))
                            continue
                        g, h = g.reshape(p, bins), h.reshape(p, bins)
                        _, f, cut = best_split(g, h, ridge, least_weight, least_gain)
                        out.append((slot, f, cut, value(g[0].sum(), h[0].sum())))
                columns = list(zip(*out)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.float64()))],
                                                 names=["slot", "feature", "cut", "value"])

            sums = slot_sums(blocks, slopes).select("slot", vector_to_array("sums").alias("sums"))
            splits = sums.mapInArrow(choose, "slot long, feature int, cut int, value double").collect()
            open_nodes = set()
            for slot, f, cut, value in splits:
                c, node = slot >> 32, slot & 0xFFFFFFFF
                trees[c].value[node] = value
                if f != NO_SPLIT:
                    trees[c].feature[node], trees[c].cut[node] = f, cut
                    open_nodes |= {(c, 2 * node + 1), (c, 2 * node + 2)}
        model.rounds.append(trees)
    return model


def unbaked(x: np.ndarray, p: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Bins and margins of a packed block."""
    return x[:, :p].astype(np.uint8), x[:, p : p + classes]


def with_margins(blocks: DataFrame, borders: np.ndarray, rounds: list[list[Tree]], classes: int) -> DataFrame:
    """Blocks of bins and margins: of raw values where there are no margins yet, else with the rounds' trees added."""
    p = len(borders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y, fold in unpacked(batches):
            if x.shape[1] == p:
                cells, kept = binned(x, borders), np.zeros((len(x), classes))
            else:
                cells, kept = unbaked(x, p, classes)
            packed = np.column_stack([cells.astype(float), kept + margins(cells, rounds, classes)])
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(x)], pa.int64()), *[pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in (packed, y, fold)]],
                names=["n", "x", "y", "fold"])

    return materialise(blocks.mapInArrow(run, BLOCKS))
