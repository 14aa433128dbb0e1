"""Tuning grids trained side by side: each scan of the rows gives the gradient of every grid point in every fold."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattweave.operators.blocks import collected_sums, to_blocks
from wattweave.operators.knn import matrix
from wattweave.operators.models import class_labels, labelled
from wattweave.operators.ranking import stratified_folds

WHOLE = -1
#: Rows whose layers are held at once.
SCAN_ROWS = 512
FIRST_STEP, LEAST_STEP, MOST_STEP = 0.05, 1e-7, 1.0


@dataclass(frozen=True)
class Perceptron:
    """One hidden layer of logistic units and a softmax over the classes, fitted to cross entropy."""

    hidden: int

    def size(self, p: int, classes: int) -> int:
        return (p + 1) * self.hidden + (self.hidden + 1) * classes

    def start(self, p: int, classes: int, rng: np.random.Generator) -> np.ndarray:
        return rng.uniform(-0.3, 0.3, self.size(p, classes))

    def _layers(self, w: np.ndarray, p: int, classes: int):
        cut = (p + 1) * self.hidden
        return w[:cut].reshape(p + 1, self.hidden), w[cut:].reshape(self.hidden + 1, classes)

    def _forward(self, w, x, classes):
        one, two = self._layers(w, x.shape[1], classes)
        inner = 1.0 / (1.0 + np.exp(-np.clip(x @ one[:-1] + one[-1], -500, 500)))
        out = inner @ two[:-1] + two[-1]
        out = np.exp(out - out.max(1, keepdims=True))
        return two, inner, out / out.sum(1, keepdims=True)

    def gradients(self, ws: np.ndarray, x: np.ndarray, y: np.ndarray, classes: int, learn: np.ndarray) -> np.ndarray:
        """The slopes of several models at once; learn has a column per model, 1 for the rows that it learns from."""
        if len(x) > SCAN_ROWS:
            some = (slice(a, a + SCAN_ROWS) for a in range(0, len(x), SCAN_ROWS))
            return sum(self.gradients(ws, x[part], y[part], classes, learn[part]) for part in some)
        n, p, m = len(x), x.shape[1], len(ws)
        layers = [self._layers(w, p, classes) for w in ws]
        one, two = np.concatenate([a for a, _ in layers], axis=1), np.stack([b for _, b in layers])
        inner = one[:-1].T @ x.T + one[-1][:, None]  # rows last: sums over units and classes run along them
        inner = (1.0 / (1.0 + np.exp(-np.clip(inner, -500, 500)))).reshape(m, self.hidden, n)
        share = two[:, :-1].transpose(0, 2, 1) @ inner + two[:, -1][:, :, None]
        share = np.exp(share - share.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
        share[:, y, np.arange(n)] -= 1.0
        share *= learn.T[:, None]
        back = ((two[:, :-1] @ share) * inner * (1.0 - inner)).reshape(-1, n)
        first = np.column_stack([back @ x, back.sum(1)]).reshape(m, self.hidden, p + 1).transpose(0, 2, 1)
        second = np.concatenate([inner @ share.transpose(0, 2, 1), share.sum(2)[:, None]], axis=1)
        return np.hstack([first.reshape(m, -1), second.reshape(m, -1)])

    def moved(self, w: np.ndarray, centre: np.ndarray, scale: np.ndarray, classes: int) -> np.ndarray:
        """The weights that give on x what w gives on (x - centre) / scale."""
        one, two = self._layers(w, len(centre), classes)
        first = one[:-1] / scale[:, None]
        return np.concatenate([first.ravel(), one[-1] - centre @ first, two.ravel()])

    def moved_back(self, slope: np.ndarray, centre: np.ndarray, scale: np.ndarray, classes: int) -> np.ndarray:
        """The slope in w, given the one in moved(w)."""
        one, two = self._layers(slope, len(centre), classes)
        return np.concatenate([((one[:-1] - centre[:, None] * one[-1]) / scale[:, None]).ravel(), one[-1], two.ravel()])

    def gradient(self, w: np.ndarray, x: np.ndarray, y: np.ndarray, classes: int) -> np.ndarray:
        return self.gradients(w[None], x, y, classes, np.ones((len(x), 1)))[0]

    def penalty(self, w: np.ndarray, p: int, classes: int) -> np.ndarray:
        return np.zeros(len(w))

    def probabilities(self, w: np.ndarray, x: np.ndarray, classes: int) -> np.ndarray:
        return self._forward(w, x, classes)[2]


@dataclass(frozen=True)
class PairwiseMachine:
    """Linear support vector machines of each class against each other (squared hinge loss, cost C), and their votes."""

    cost: float

    def size(self, p: int, classes: int) -> int:
        return (p + 1) * (classes * (classes - 1) // 2)

    def start(self, p: int, classes: int, rng: np.random.Generator) -> np.ndarray:
        return np.zeros(self.size(p, classes))

    @staticmethod
    def pairs(classes: int) -> np.ndarray:
        return np.array(list(itertools.combinations(range(classes), 2)), int).reshape(-1, 2)

    def gradients(self, ws: np.ndarray, x: np.ndarray, y: np.ndarray, classes: int, learn: np.ndarray) -> np.ndarray:
        """The slopes of several models at once; learn has a column per model, 1 for the rows that it learns from.

        Rows of a class meet only the machines of that class: the others have no slope from them.
        """
        p, pairs = x.shape[1], self.pairs(classes)
        ws = ws.reshape(len(ws), -1, p + 1)
        out = np.zeros(ws.shape)
        for c in np.unique(y):
            own = np.flatnonzero((pairs == c).any(1))
            some, w = x[y == c], ws[:, own].reshape(-1, p + 1)
            side = np.tile(np.where(pairs[own, 0] == c, 1.0, -1.0), len(ws))
            pull = np.maximum(0.0, 1.0 - (some @ w[:, :-1].T + w[:, -1]) * side) * (side * (-2.0 * self.cost))
            pull *= np.repeat(learn[y == c], len(own), axis=1)
            out[:, own] += np.column_stack([pull.T @ some, pull.sum(0)]).reshape(len(ws), len(own), p + 1)
        return out.reshape(len(ws), -1)

    def moved(self, w: np.ndarray, centre: np.ndarray, scale: np.ndarray, classes: int) -> np.ndarray:
        """The weights that give on x what w gives on (x - centre) / scale."""
        w = w.reshape(-1, len(centre) + 1)
        first = w[:, :-1] / scale
        return np.column_stack([first, w[:, -1] - first @ centre]).ravel()

    def moved_back(self, slope: np.ndarray, centre: np.ndarray, scale: np.ndarray, classes: int) -> np.ndarray:
        """The slope in w, given the one in moved(w)."""
        slope = slope.reshape(-1, len(centre) + 1)
        return np.column_stack([(slope[:, :-1] - slope[:, -1:] * centre) / scale, slope[:, -1]]).ravel()

    def gradient(self, w: np.ndarray, x: np.ndarray, y: np.ndarray, classes: int) -> np.ndarray:
        return self.gradients(w[None], x, y, classes, np.ones((len(x), 1)))[0]

    def penalty(self, w: np.ndarray, p: int, classes: int) -> np.ndarray:
        out = w.reshape(-1, p + 1).copy()
        out[:, -1] = 0.0
        return out.ravel()

    def probabilities(self, w: np.ndarray, x: np.ndarray, classes: int) -> np.ndarray:
        """Shares of the votes; equal votes go to the class named first."""
        w, pairs = w.reshape(-1, x.shape[1] + 1), self.pairs(classes)
        won = np.where(x @ w[:, :-1].T + w[:, -1] > 0, pairs[:, 0], pairs[:, 1])
        votes = np.stack([(won == c).sum(1) for c in range(classes)], 1).astype(float)
        return votes / max(1, len(pairs))


class SignSteps:
    """Resilient steps: each weight has a step that grows while its slope keeps its sign and halves where it turns."""

    def __init__(self, n: int):
        self.step, self.last = np.full(n, FIRST_STEP), np.zeros(n)

    def move(self, w: np.ndarray, slope: np.ndarray) -> np.ndarray:
        turn = self.last * slope
        self.step = np.clip(np.where(turn > 0, self.step * 1.2, np.where(turn < 0, self.step * 0.5, self.step)), LEAST_STEP, MOST_STEP)
        self.last = np.where(turn < 0, 0.0, slope)
        return w - np.sign(self.last) * self.step


@dataclass(frozen=True)
class GridModel:
    """The best grid point fitted on all rows."""

    family: Perceptron | PairwiseMachine
    classes: list[str]
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def transform(self, df: DataFrame, features: str = "features", prediction: str = "predicted") -> DataFrame:
        """Add the predicted class and the probability of that class (its share of the votes)."""
        model = self

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = (matrix(batch.column(features)) - model.centre) / model.scale
                    share = model.family.probabilities(model.weights, x, len(model.classes))
                    best = share.argmax(1)
                    yield pa.RecordBatch.from_arrays(
                        [*batch.columns, pa.array([model.classes[i] for i in best], pa.string()), pa.array(share[np.arange(len(best)), best])],
                        [*batch.schema.names, prediction, "probability"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        return df.mapInArrow(score, f"{fields}, `{prediction}` string, probability double")


@dataclass(frozen=True)
class Tuned:
    model: GridModel
    report: DataFrame


def fold_scalers(blocks: DataFrame, folds: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Mean and sample deviation of the rows each fold is trained on; the fold WHOLE is trained on all."""

    def moments(x, y, fold):
        for f in folds:
            some = x[fold != f]
            yield f, np.concatenate([[len(some)], some.sum(0), (some * some).sum(0)])

    out = {}
    for f, s in collected_sums(blocks, moments).items():
        n, total, squares = s[0], s[1 : 1 + len(s) // 2], s[1 + len(s) // 2 :]
        centre = total / max(n, 1)
        spread = np.sqrt(np.maximum(squares - n * centre * centre, 0.0) / max(n - 1, 1))
        out[f] = centre, np.where(spread > 1e-12, spread, 1.0)
    return out


def tune(df: DataFrame, label: str, key: str, settings: dict[str, Perceptron | PairwiseMachine], folds: int = 10,
         iterations: int = 100, seed: int = 100, features: str = "features") -> Tuned:
    """Accuracy of every setting over class-balanced folds, and the best setting fitted on all rows.

    All settings in all folds, and each on all rows, move together: an iteration is one scan of the packed rows, in which
    every task sums the slopes of each model over its rows outside the model's fold. Models are small and stay on the
    driver. Features are scaled with the rows that a fold is trained on. Report: (setting, accuracy, accuracy_sd, is_best),
    the deviation over folds; the first of equal settings is best. Rows without a label are not learned from.
    """
    rows = labelled(df, label)
    classes = class_labels(rows, label)
    place = F.array_position(F.array(*map(F.lit, classes)), F.col(label).cast("string")) - 1
    folded = stratified_folds(rows, label, key, folds, seed)
    blocks = to_blocks(folded, features, place, F.col("fold"))
    all_folds, names, k = [*range(folds), WHOLE], list(settings), len(classes)
    scalers = fold_scalers(blocks, all_folds)
    p = len(scalers[WHOLE][0])
    slots = {(f, s): i for i, (f, s) in enumerate(itertools.product(all_folds, range(len(names))))}
    families = [settings[n] for n in names]
    weights = {slot: families[s].start(p, k, np.random.default_rng(seed + s)) for (_, s), slot in slots.items()}
    movers = {slot: SignSteps(len(w)) for slot, w in weights.items()}

    middle = scalers[WHOLE][0]
    spaces = {f: (centre - middle, scale) for f, (centre, scale) in scalers.items()}

    def slopes(x, y, fold):
        x, number = x - middle, y.astype(int)
        learn = (fold[:, None] != np.array(all_folds)).astype(float)
        for s, family in enumerate(families):
            for f, of, slope in zip(all_folds, learn.T, family.gradients(moved[s], x, number, k, learn)):
                if of.any():
                    yield slots[f, s], slope

    for _ in range(iterations):
        moved = [np.stack([family.moved(weights[slots[f, s]], *spaces[f], k) for f in all_folds]) for s, family in enumerate(families)]
        found = collected_sums(blocks, slopes)
        for (f, s), slot in slots.items():
            if slot in found:
                slope = families[s].moved_back(found[slot], *spaces[f], k)
                weights[slot] = movers[slot].move(weights[slot], slope + families[s].penalty(weights[slot], p, k))

    def hits(x, y, fold):
        for f in range(folds):
            held = fold == f
            if held.any():
                scaled = (x[held] - scalers[f][0]) / scalers[f][1]
                for s, family in enumerate(families):
                    best = family.probabilities(weights[slots[f, s]], scaled, k).argmax(1)
                    yield slots[f, s], np.array([held.sum(), (best == y[held]).sum()], float)

    counted = collected_sums(blocks, hits)
    shares = [[counted[slots[f, s]][1] / counted[slots[f, s]][0] for f in range(folds) if slots[f, s] in counted] for s in range(len(names))]
    means = [float(np.mean(x)) for x in shares]
    best = means.index(max(means))
    report = [(n, m, float(np.std(x)), i == best) for i, (n, m, x) in enumerate(zip(names, means, shares))]
    schema = "setting string, accuracy double, accuracy_sd double, is_best boolean"
    model = GridModel(families[best], classes, weights[slots[WHOLE, best]], *scalers[WHOLE])
    return Tuned(model, df.sparkSession.createDataFrame(report, schema))
