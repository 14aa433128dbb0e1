"""Language identification by blended-spectrum string kernels, Nyström landmarks and kernel ridge regression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattweave.llm.common import free_name, small_batches, task

ORDERS = (1, 2, 3, 4)
BINS = 4_096
LANDMARKS = 256
TRAIN_ROWS = 8_000
RIDGE = 1e-3
UNKNOWN = "und"
#: The border of `least_score`.
HELD_BACK, LOW_SHARE, LOW_PART = 5, 0.001, 0.5
RUN = 500_000
#: Characters of a window. Windows cover the whole text; one fills well under all of the bins.
WINDOW = 8_000
ODD = np.uint64(0x9E3779B97F4A7C15)


def presence(texts: list[str]) -> np.ndarray:
    """A row of 0/1 per text: for each order n, which bins the character n-grams of the whole text fall into.

    Upper case and what is not a letter count too, in lower case; a longer text than RUN characters is read in pieces
    that overlap by the longest order, so that each n-gram is seen once or more.
    """
    out = np.zeros((len(texts), BINS), np.bool_)
    flat = out.reshape(-1)
    for row, text in enumerate(texts):
        text = text.lower()
        for start in range(0, max(1, len(text)), RUN):
            codes = np.frombuffer(text[start : start + RUN + max(ORDERS) - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            gram = np.zeros(len(codes) + 1, np.uint64)
            for n in range(1, max(ORDERS) + 1):
                if len(codes) < n:
                    break
                gram = gram[:-1] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(n)
                if n in ORDERS:
                    flat[((gram * ODD) >> np.uint64(64 - 12)).astype(np.int64) + row * BINS] = True
    return out


def windows(text: str) -> list[str]:
    """The whole text in parts of equal length, WINDOW or less, that overlap so that no n-gram is cut."""
    step = max(1, -(-len(text) // max(1, -(-len(text) // WINDOW))))
    return [text[i : i + step + max(ORDERS) - 1] for i in range(0, len(text), step)] or [text]


def unit_windows(texts: list[str]):
    """Some windows at a time: the text each is of, and its row of presence over the root of its sum, times its share."""
    rows, parts, shares = [], [], []
    for i, text in enumerate(texts):
        some = windows(text)
        rows += [i] * len(some)
        parts += some
        shares += [1 / len(some)] * len(some)
    for i in range(0, len(parts), 256):
        x = presence(parts[i : i + 256]).astype(np.float32)
        norm = np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
        yield np.array(rows[i : i + 256]), x, norm, np.array(shares[i : i + 256])[:, None]


@dataclass
class Model:
    """languages in code point order, and weights (bins by languages): the landmarks' kernel columns times the
    coefficients. The kernel is linear in presence, so one matrix product scores a batch. A long text's values are the means of its windows' values."""

    languages: list[str]
    weights: np.ndarray

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        values = np.zeros((len(texts), len(self.languages)))
        for rows, x, norm, shares in unit_windows(texts):
            np.add.at(values, rows, (x @ self.weights) / norm * shares)
        best = values.argmax(axis=1)
        return [self.languages[i] for i in best], np.clip(values[np.arange(len(texts)), best], 0.0, 1.0).astype(float)


def features(text: str) -> bytes:
    """The bits of a text of one window, or else the mean of the windows' unit rows as half floats."""
    if len(windows(text)) == 1:
        return np.packbits(presence([text])[0]).tobytes()
    return sum((x / norm * shares).sum(axis=0) for _, x, norm, shares in unit_windows([text])).astype(np.float16).tobytes()


def fit(x: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE, norm: np.ndarray | None = None) -> Model:
    """One-versus-rest kernel ridge regression in the span of the landmarks, which are dealt evenly to the languages.

    k(a, b) = shared bins / sqrt(bins of a * bins of b), and the mean of it over the windows of long texts; norm is what
    rows are divided by, if not the root of their sums; z = k(x, landmarks) W^-1/2; targets are 0 and 1, and each
    language weighs the same.
    """
    languages = sorted(set(labels))
    y = np.array([[label == language for language in languages] for label in labels], np.float64)
    if norm is None:
        norm = np.sqrt(np.maximum(x.sum(axis=1, keepdims=True, dtype=np.int64), 1))
    each = max(1, landmarks // len(languages))
    chosen = np.concatenate([np.flatnonzero(y[:, c])[:each] for c in range(len(languages))])
    marks = x[chosen] / norm[chosen]
    values, vectors = np.linalg.eigh(marks @ marks.T)
    keep = values > 1e-8 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    # some rows at a time: the bits of all rows are small, their floats are not
    z = np.concatenate([(x[i : i + 500] / norm[i : i + 500]) @ marks.T @ root for i in range(0, len(x), 500)])
    weight = (y / y.sum(axis=0)).sum(axis=1)[:, None] / len(languages)
    beta = np.linalg.solve(z.T @ (weight * z) + ridge * np.eye(z.shape[1]), z.T @ (weight * y))
    return Model(languages, (marks.T @ (root @ beta)).astype(np.float32))


def training_rows(docs: DataFrame, most: int) -> DataFrame:
    """lang and text of about `most` rows, evenly over the languages, chosen by a hash of text and id."""
    known = docs.select(F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("crc"), "doc_id", "lang",
                        F.coalesce("text", F.lit("")).alias("text")).where("lang is not null and crc % 5 <> 0")
    known = known.where(F.col("text").rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()}
    if not counts:
        return known.select("lang", "text").limit(0)
    share, at = F.lit(0), F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    for language, n in counts.items():
        share = F.when(F.col("lang") == language, int(min(1.0, most / len(counts) / n) * (1 << 30))).otherwise(share)
    return known.where(at < share).select("lang", "text")


def sample(docs: DataFrame, most: int) -> tuple[np.ndarray, list[str], np.ndarray] | None:
    """Presence, labels and norms of rows whose crc32(doc_id) mod 5 is not 0: about `most` rows, the documented bound.

    Presence is computed by the executors; BINS bits a row come to the driver, about 4 MB in all, and BINS half floats a
    row of more than a window, at most 64 MB. The rows are in an order that has nothing to do with their labels.
    """

    def bits(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array([features(t) for t in b.column("text").to_pylist()], pa.binary())],
                                             names=["lang", "bits"])

    rows = training_rows(docs, most).mapInArrow(task(bits), "lang string, bits binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r[0], bytes(r[1])))
    order = np.random.default_rng(5).permutation(len(rows))
    labels = [rows[i][0] for i in order]
    x, norm = np.zeros((len(rows), BINS), np.float16), np.ones((len(rows), 1))
    for place, i in enumerate(order):
        bits = np.frombuffer(bytes(rows[i][1]), np.uint8)
        if len(bits) == BINS // 8:
            x[place] = np.unpackbits(bits)
            norm[place] = np.sqrt(max(1, np.count_nonzero(x[place])))
        else:
            x[place] = bits.view(np.float16)
    return x, labels, norm


def train(docs: DataFrame, most: int = TRAIN_ROWS, landmarks: int = LANDMARKS) -> Model | None:
    """Learn from the sample; none without a row that has a language and a doc_id."""
    known = sample(docs, most)
    return known and fit(known[0], known[1], landmarks, norm=known[2])


def least_score(x: np.ndarray, labels: list[str], norm: np.ndarray, landmarks: int = LANDMARKS) -> float:
    """The score below which a text is like none of the languages: LOW_PART of what the lowest LOW_SHARE of rows reach
    that their model has not seen.

    One row in HELD_BACK is held back and scored by a model of the others. Rows whose language that model gets wrong
    count too, so the border lies below nearly all that the table itself calls a language. 0 without a row to hold back.
    """
    cut = len(labels) - len(labels) // HELD_BACK
    if cut == len(labels):
        return 0.0
    model = fit(x[:cut], labels[:cut], landmarks, norm=norm[:cut])
    best = [((x[i : i + 500] / norm[i : i + 500]) @ model.weights).max(axis=1) for i in range(cut, len(labels), 500)]
    return float(LOW_PART * max(0.0, np.quantile(np.concatenate(best), LOW_SHARE)))


def learnable(docs: DataFrame) -> DataFrame:
    """lang, text and held of every row that may be learned from; one in HELD_BACK is held, by a hash of text and id."""
    known = docs.select(F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("crc"), "doc_id", "lang",
                        F.coalesce("text", F.lit("")).alias("text")).where("lang is not null and crc % 5 <> 0")
    held = F.pmod(F.xxhash64(F.lit("held"), "doc_id", "text"), F.lit(HELD_BACK)) == 0
    return known.where(F.col("text").rlike(r"\p{L}")).select("lang", "text", held.alias("held"))


@dataclass
class Basis:
    """The landmarks' rows and what they are divided by, and the root that makes their kernel columns independent."""

    marks: np.ndarray
    norm: np.ndarray
    root: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, labels: list[str], norm: np.ndarray, landmarks: int = LANDMARKS) -> Basis:
        languages, named = sorted(set(labels)), np.array(labels)
        each = max(1, landmarks // len(languages))
        chosen = np.concatenate([np.flatnonzero(named == language)[:each] for language in languages])
        marks = x[chosen].astype(np.float64) / norm[chosen]
        values, vectors = np.linalg.eigh(marks @ marks.T)
        keep = values > 1e-8 * values[-1]
        return cls(x[chosen].astype(np.float32), norm[chosen], vectors[:, keep] / np.sqrt(values[keep]))

    def place(self, texts: list[str]) -> np.ndarray:
        """The texts in the span of the landmarks. Shared bins are whole numbers, which float32 adds without rounding."""
        near = np.zeros((len(texts), len(self.marks)))
        for rows, x, norm, shares in unit_windows(texts):
            np.add.at(near, rows, (x @ self.marks.T) / norm / self.norm.T * shares)
        return near @ self.root

    def model(self, languages: list[str], gram: np.ndarray, goal: np.ndarray, ridge: float = RIDGE) -> Model:
        beta = np.linalg.solve(gram + ridge * np.eye(len(gram)), goal)
        return Model(languages, ((self.marks / self.norm).T @ (self.root @ beta)).astype(np.float32))


def fit_all(docs: DataFrame, basis: Basis, languages: list[str]) -> tuple[Model, Model, int]:
    """The ridge regression of `fit` over every row that may be learned from: the model of all of them, the one without
    the held rows, and how many are held.

    Tasks add up the products of their rows in the span of the landmarks; a row of these sums is a row of a landmark, so
    what is shuffled and collected has the size of the basis, whatever the number of documents.
    """
    known = learnable(docs).where(F.col("lang").isin(languages))
    counts = {(r["lang"], r["held"]): r["count"] for r in known.groupBy("lang", "held").count().collect()}
    totals = [[sum(counts.get((x, h), 0) for h in which) for x in languages] for which in ((False, True), (False,))]
    weights = [{x: 1 / n / sum(m > 0 for m in some) for x, n in zip(languages, some) if n} for some in totals]
    at = {x: i for i, x in enumerate(languages)}
    r, k = basis.root.shape[1], len(languages)

    def sums(batches):
        total = np.zeros((r, 2 * (r + k)))
        for b in batches:
            texts, langs, held = (b.column(c).to_pylist() for c in ("text", "lang", "held"))
            for i in range(0, len(texts), 256):
                z, some = basis.place(texts[i : i + 256]), langs[i : i + 256]
                of = np.eye(k)[[at[x] for x in some]]
                everyone = np.array([weights[0][x] for x in some])
                learned = np.array([0.0 if h else weights[1][x] for x, h in zip(some, held[i : i + 256])])
                for j, weight in enumerate((everyone, learned)):
                    total[:, j * (r + k) : (j + 1) * (r + k)] += z.T @ (weight[:, None] * np.hstack([z, of]))
        yield pa.RecordBatch.from_arrays([pa.array(range(r), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["row", "sums"])

    small_batches(docs.sparkSession)
    added = known.mapInArrow(task(sums), "row int, sums array<double>").groupBy("row").agg(
        Summarizer.sum(array_to_vector("sums")).alias("sums")).collect()
    total = np.zeros((r, 2 * (r + k)))
    for found in added:
        total[found["row"]] = found["sums"].toArray()
    models = [basis.model(languages, half[:, :r], half[:, r:]) for half in (total[:, : r + k], total[:, r + k :])]
    return models[0], models[1], sum(n for (_, held), n in counts.items() if held)


def least_held_score(docs: DataFrame, model: Model, n: int) -> float:
    """What `least_score` says of its rows, of all `n` held rows of docs: model has not learned from them."""
    if not n:
        return 0.0
    held = learnable(docs).where(F.col("held") & F.col("lang").isin(model.languages))

    def out(b, found, scores):
        return pa.RecordBatch.from_arrays([pa.array(scores, pa.float64())], names=["score"])

    scores = predict(held.select("text"), model, "score double", out)
    place = LOW_SHARE * (n - 1)
    below = int(place)
    pair = scores.orderBy("score").limit(below + 2).orderBy(F.desc("score")).limit(2 if below + 2 <= n else 1).collect()
    high, low = pair[0][0], pair[-1][0]
    return float(LOW_PART * max(0.0, low + (high - low) * (place - below)))


def predict(docs: DataFrame, model: Model | None, columns: str, out) -> DataFrame:
    """mapInArrow over batches; out(batch, languages, scores) gives the arrays of `columns`. No shuffle."""

    whole, lettered = free_name(docs, "__text"), free_name(docs, "__letters")

    def run(batches):
        for b in batches:
            found, scores = [], []
            texts, letters = b.column(whole).to_pylist(), b.column(lettered).to_pylist()
            for i in range(0, len(texts), 256):
                some = texts[i : i + 256]
                lang, score = model.score(some) if model else ([UNKNOWN] * len(some), np.zeros(len(some)))
                found += lang
                scores += score.tolist()
            found = [x if has else UNKNOWN for x, has in zip(found, letters)]
            scores = [x if has else 0.0 for x, has in zip(scores, letters)]
            yield out(b, found, scores)

    small_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({whole: text, lettered: text.rlike(r"\p{L}")}).mapInArrow(task(run), columns)


def identify(docs: DataFrame, most: int = TRAIN_ROWS, landmarks: int = LANDMARKS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text.

    lang and doc_id serve to choose what is learned; a prediction sees the text alone. A text that is null or has no
    letter is `und` with score 0, as is every text if nothing can be learned. held_out is false for a null doc_id,
    which isn't learned from either. Repeated rows stay, a row each. Empty table: no rows. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out"))

    def out(b, found, scores):
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("held_out"), pa.array(found, pa.string()), pa.array(scores, pa.float64())],
            names=["doc_id", "held_out", "lang_pred", "score"])

    return predict(rows, train(docs, most, landmarks), "doc_id long, held_out boolean, lang_pred string, score double", out)


def with_language(docs: DataFrame, least: float | None = None, most: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs, with all their columns, whose language is known with a score of `least` or more.

    The model learns from every row that it may learn from; `most` bounds the rows of which the landmarks are chosen.
    Without `least` the border is that of `least_score` over all held rows. A text in no language that was learned, or
    noise with a few letters, stays below it.
    """
    columns, known, model = docs.columns, sample(docs, most), None
    if known:
        x, labels, norm = known
        model, without, held = fit_all(docs, Basis.of(x, labels, norm), sorted(set(labels)))
        least = least_held_score(docs, without, held) if least is None else least
        del x
    del known

    def out(b, found, scores):
        keep = pa.array([x != UNKNOWN and s >= least for x, s in zip(found, scores)], pa.bool_())
        return b.select(columns).filter(keep)

    return predict(docs, model, docs.schema, out)
