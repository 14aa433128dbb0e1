"""Jaccard join of word shingles by chosen paths: sets are split on sampled shared tokens until buckets are small."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattweave.llm.common import id_and_text, join_counted, stored, task
from wattweave.llm.graphs import components
from wattweave.llm.homes import COUNT, Homes

SHINGLE = 5
LEAST = 0.8
RECALL = 0.999999
LIMIT = 1_024
DEPTH = 4
DEEP_RATE = 3.0
BLOCK = 512
DENSE = 0.4
BINS = 64
#: Odd multipliers without structure.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                    0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)
POINTS = "place long, doc_id long, sig binary, n int, sketch binary, paths array<long>, row string"
LOW = (1 << 33) - 1


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * FACTORS[0]
    h = (h ^ (h >> np.uint64(29))) * FACTORS[5]
    return h ^ (h >> np.uint64(32))


def word_hashes(data: bytes, block: int = 1 << 21) -> np.ndarray:
    """A hash of each word, the runs of bytes other than 0x20 and 0x09-0x0D. Blocks end between words."""
    found, start = [], 0
    while start < len(data):
        end = start + block
        while end < len(data) and not (data[end] == 32 or 9 <= data[end] <= 13):
            end += 1
        b = np.frombuffer(data, np.uint8, count=min(end, len(data)) - start, offset=start)
        inside = ~((b == 32) | ((b >= 9) & (b <= 13)))
        step = np.diff(inside.astype(np.int8), prepend=0, append=0)
        begin, stop = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        if len(begin):
            length = stop - begin
            inner = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            powers = np.multiply.accumulate(np.full(int(length.max()) + 1, FACTORS[1]))
            values = (b[inside].astype(np.uint64) + np.uint64(1)) * powers[inner]
            found.append(mixed(np.add.reduceat(values, np.cumsum(length) - length) + length.astype(np.uint64)))
        start = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def tokens_of(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a text of fewer words has one shingle of all of them."""
    w = word_hashes(text.encode("utf-8"))
    if not len(w):
        return w
    size = min(shingle, len(w))
    h = np.full(len(w) - size + 1, np.uint64(size))
    for k in range(size):
        h = h * FACTORS[2] + w[k : len(w) - size + 1 + k]
    return np.unique(mixed(h))


def sketch_of(tokens: np.ndarray) -> bytes:
    """One permutation, BINS bins: a byte of each bin's least value, and a bit for each bin that has one."""
    v = np.sort(mixed(tokens * FACTORS[3] + FACTORS[4]))
    bin_of = (v >> np.uint64(58)).astype(np.int64)
    first = np.flatnonzero(np.diff(bin_of, prepend=-1))
    out, has = np.zeros(BINS, np.uint8), np.zeros(BINS, np.uint8)
    out[bin_of[first]] = (v[first] & np.uint64(255)).astype(np.uint8)
    has[bin_of[first]] = 1
    return out.tobytes() + np.packbits(has).tobytes()


def plausible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of rows of sketches can be similar: six standard deviations below the matches expected at `least`."""
    fa, fb = np.unpackbits(a[:, BINS:], axis=1).astype(bool), np.unpackbits(b[:, BINS:], axis=1).astype(bool)
    out = np.zeros((len(a), len(b)), bool)
    for i in range(len(a)):
        match = ((a[i, :BINS] == b[:, :BINS]) & fa[i] & fb).sum(axis=1)
        either = (fa[i] | fb).sum(axis=1)
        ratio = np.minimum(na[i], nb) >= least * np.maximum(na[i], nb) - 1e-9
        out[i] = ratio & (match >= least * either - 6 * np.sqrt(least * (1 - least) * either))
    return out


def sampled(tokens: np.ndarray, path: np.uint64, rate: float, taken=()) -> np.ndarray:
    """The tokens that extend a path: a token's hash under the path is below rate / size of the set."""
    border = min(1.0, rate / len(tokens))
    h = mixed(tokens ^ mixed(np.array([path]))[0])
    some = tokens[(h >> np.uint64(11)).astype(np.float64) < border * 2.0**53]
    return some[~np.isin(some, np.array(taken, np.uint64))] if len(taken) else some


def first_paths(tokens: np.ndarray, salts: tuple[np.ndarray, np.ndarray], rate: float) -> np.ndarray:
    """All runs at once: what extended(run, sampled(tokens, run, rate)) gives for each run, whose hashes are the salts."""
    border = min(1.0, rate / len(tokens))
    h = mixed(tokens[None, :] ^ salts[0][:, None])
    run, token = np.nonzero((h >> np.uint64(11)).astype(np.float64) < border * 2.0**53)
    return mixed(tokens[token] * FACTORS[6] + salts[1][run])


def extended(path: np.uint64, tokens: np.ndarray) -> np.ndarray:
    return mixed(tokens * FACTORS[6] + mixed(np.array([path]) + np.uint64(1))[0])


def groups_of(batches):
    """Groups of two or more rows with equal `k`, from batches that are sorted by it."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if rest is not None:
            t = pa.concat_tables([rest, t])
        k = t.column("k").to_numpy()
        borders = np.append(0, np.flatnonzero(np.diff(k)) + 1)
        for a, e in zip(borders[:-1], borders[1:]):
            if e - a > 1:
                yield t.slice(a, e - a)
        rest = t.slice(int(borders[-1]))
    if rest is not None and rest.num_rows > 1:
        yield rest


def local_roots(links: np.ndarray) -> np.ndarray:
    """The least number in each row's component."""
    root = np.full(len(links), -1)
    for i in range(len(links)):
        if root[i] < 0:
            root[i], waiting = i, [i]
            while waiting:
                new = np.flatnonzero(links[waiting.pop()] & (root < 0))
                root[new] = i
                waiting.extend(new.tolist())
    return root


def bytes_matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def crossed(half: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Only the pairs that a task is for: all of them within a block, those between the halves of two blocks."""
    np.fill_diagonal(matrix, False)
    return matrix if half[0] < 0 else matrix & (half[:, None] != half[None, :])


def sketch_edges(batches, least: float):
    """(a, b): the plausible pairs of each bucket as stars of their components."""
    for t in groups_of(batches):
        place, n, half = (t.column(c).to_numpy() for c in ("place", "n", "half"))
        s = bytes_matrix(t.column("sketch"), BINS + BINS // 8)
        root = local_roots(crossed(half, plausible(s, s, n, n, least)))
        some = np.flatnonzero(root != np.arange(len(root)))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(place[root[some]]), pa.array(place[some])], names=["a", "b"])


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections by products of the incidence matrix, some tokens at a time."""
    every = np.concatenate(sets)
    _, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    often = counts > 1
    number = np.cumsum(often) - 1
    keep = often[inverse]
    row, column = row[keep], number[inverse[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for a in range(0, int(often.sum()), 4_096):
        lo, hi = np.searchsorted(column, [a, a + 4_096])
        x = np.zeros((len(sets), 4_096), np.float32)
        x[row[lo:hi], column[lo:hi] - a] = 1
        out += x @ x.T
    return out


def exact_links(batches, least: float):
    """(place, links, root): for each member of a block pair its number of similar members and its local root."""
    for t in groups_of(batches):
        place, half = t.column("place").to_numpy(), t.column("half").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in t.column("tokens").to_pylist()]
        n = np.array([len(s) for s in sets], np.float64)
        if len(sets) == 2:
            both = float(len(np.intersect1d(sets[0], sets[1], assume_unique=True)))
            shared = np.array([[n[0], both], [both, n[1]]])
        else:
            shared = shared_counts(sets)
        links = crossed(half, shared >= least * (n[:, None] + n[None, :] - shared) - 1e-9)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(links.sum(axis=1).astype(np.int64)),
                                          pa.array(place[local_roots(links)])], names=["place", "links", "root"])


def likeness(buckets: DataFrame, reps: DataFrame, bins: int = 8) -> DataFrame:
    """(path, alike): about the mean similarity of each bucket's pairs. Each set shows one of so many bins of its sketch,
    by a hash of its place; counts of equal values in a bin stand for the pairs."""
    each = buckets.select("path", "place").join(reps.select("place", "sketch"), "place").withColumn(
        "bin", F.pmod(F.xxhash64("place", F.lit(3)), F.lit(bins)).cast("int"))
    counts = each.groupBy("path", "bin", F.expr("substring(sketch, bin + 1, 1)").alias("v")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    pairs = counts.groupBy("path", "bin").agg(F.sum(F.col("n") * F.col("n")).alias("same"), F.sum("n").alias("all"))
    return pairs.groupBy("path").agg((F.sum("same") / F.sum(F.col("all") * F.col("all"))).alias("alike"))


def in_blocks(df: DataFrame, group: str, size: int) -> DataFrame:
    """Rows with `members` (of the group) dealt to pairs of blocks of about `size` rows: k, half and the old columns.

    A row of a group of one block keeps the group as k and has half -1. Otherwise it goes to each pair of blocks that
    has its own, with half 0 or 1; to its own block's inner pairs with half -1.
    """
    parts = F.ceil(F.col("members") / F.lit(size)).cast("int")
    own = F.pmod(F.xxhash64("place", F.lit(11)), F.col("parts")).cast("int")
    df = df.withColumn("parts", parts).withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    k = F.when(F.col("parts") == 1, F.col(group)).otherwise(
        F.xxhash64(group, F.least("own", "other"), F.greatest("own", "other")))
    half = F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") > F.col("other")).cast("int"))
    return df.withColumn("k", k).withColumn("half", half.cast("int")).drop("parts", "own", "other")


def similar_texts(docs: DataFrame, least: float = LEAST, recall: float = RECALL, shingle: int = SHINGLE,
                  limit: int = LIMIT, depth: int = DEPTH, block: int = BLOCK,
                  dense: float = DENSE, row: str | None = None) -> DataFrame:
    """doc_id, class_id, copy_id, n_links and kept of every text: similar are word shingle sets of Jaccard `least` or more.

    copy_id is the smallest doc_id of the texts with the same shingles, which count as one in what follows; n_links
    the number of other such sets that are similar; class_id the smallest doc_id that can be reached over links; kept is true for one text of each class.

    Each run samples tokens so that a similar pair shares a sampled one with probability 1 - 1/e or more; the number of
    runs comes from `recall`. A bucket of more than `limit` sets is split on further tokens, `depth` levels at most,
    unless its sets are `dense` or more alike on average, as splits do not part near copies; what is still larger is
    compared in pairs of blocks, as are families. In buckets sets meet as sketches of 72 bytes;
    components of what can be similar (six standard deviations) are families. Each family's token sets come from the
    texts' own places, once for each block they meet, and are compared exactly. No pairs are written, only counts and
    stars, so thousands of near copies give as many rows. Texts without words (null and empty) are in no group. Null
    doc_id comes after all others. Repeated rows have the same shingles. Empty table: no rows. Other columns are not
    read, but for `row`, the name of a string column that is carried along as `row`.
    """
    spark, total = docs.sparkSession, docs.count()
    runs = [np.uint64(r + 1) for r in range(max(1, math.ceil(-math.log(1 - recall))))]
    texts = id_and_text(docs, (F.col(row) if row else F.lit(None)).cast("string").alias("row"))
    home = Homes(texts, lambda r: len(r[1]))
    salts = mixed(np.array(runs)), mixed(np.array(runs) + np.uint64(1))

    def describe(part, row, rows):
        for i, (doc_id, text, name) in enumerate(rows):
            place, t = (part << 33) + row + i, tokens_of(text, shingle)
            if not len(t):
                yield place, doc_id, b"none" + place.to_bytes(8, "big"), 0, None, [], name
                continue
            sig = mixed(t).sum(dtype=np.uint64).tobytes() + (mixed(t ^ FACTORS[3])).sum(dtype=np.uint64).tobytes()
            paths = first_paths(t, salts, 1 / least)
            yield place, doc_id, sig, len(t), sketch_of(t), paths.view(np.int64).tolist(), name

    described = home.rdd.mapPartitionsWithIndex(task(lambda part, rows: numbered(part, rows, describe)))
    points = stored(spark.createDataFrame(described, POINTS, verifySchema=False), "points")
    if points.count() != total:
        raise RuntimeError("the input has other rows than when it was counted; store it and run again")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "place"))
    classes = stored(points.groupBy("sig").agg(first.alias("rep"), F.count(F.lit(1)).alias("copies")), "shingle-classes")
    reps = points.join(classes.select(F.col("rep.place").alias("place")), "place", "left_semi").where("n > 0")
    reps = stored(reps.select("place", "n", "sketch", "paths"), "representatives")

    members = reps.select("place", F.explode("paths").alias("path")).select("path", "place", F.array().cast("array<long>").alias("taken"))
    ready = []
    for level in range(1, depth + 1):
        counts = members.groupBy("path").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        met = stored(members.join(counts, "path"), "buckets")
        ready.append(met.where(F.col("members") <= limit) if level < depth else met)
        large = met.where(F.col("members") > limit)
        if level == depth or large.isEmpty():
            break
        alike = stored(likeness(large, reps).where(F.col("alike") >= dense).select("path"), "dense-buckets")
        ready.append(large.join(alike, "path", "left_semi"))
        large = large.join(alike, "path", "left_anti")

        def split(n, row, value, text):
            t = tokens_of(text, shingle)
            for path, taken in value:
                p = np.int64(path).view(np.uint64)
                own = np.array(taken, np.int64).view(np.uint64) if taken else np.unique(np.concatenate(
                    [t[extended(r, t) == p] for r in runs]))
                some = sampled(t, p, DEEP_RATE / least, own)
                for new, token in zip(extended(p, some).view(np.int64).tolist(), some.view(np.int64).tolist()):
                    yield new, (n << 33) + row, [*own.view(np.int64).tolist(), token]

        sent = large.groupBy("place").agg(F.collect_list(F.struct("path", "taken")).alias("value"))
        members = stored(spark.createDataFrame(at_home(home, points, sent, split), "path long, place long, taken array<long>",
                                               verifySchema=False), "longer-paths")

    buckets = ready[0].select("path", "place", "members")
    for more in ready[1:]:
        buckets = buckets.unionAll(more.select("path", "place", "members"))
    dealt = in_blocks(buckets, "path", limit).select("k", "half", "place").join(reps.select("place", "n", "sketch"), "place")
    dealt = dealt.repartition("k").sortWithinPartitions("k").select("k", "half", "place", "n", "sketch")
    edges = stored(dealt.mapInArrow(task(lambda b: sketch_edges(b, least)), "a long, b long").distinct(), "plausible")

    family = components(edges)
    sizes = family.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    family = in_blocks(family.withColumnRenamed("node", "place").join(sizes, "root"), "root", block)
    sent = family.groupBy("place").agg(F.collect_list(F.struct("k", "half")).alias("value"))

    def tell(part, row, value, text):
        t = tokens_of(text, shingle).tobytes()
        for k, half in value:
            yield k, half, (part << 33) + row, t

    told = spark.createDataFrame(at_home(home, points, sent, tell), "k long, half int, place long, tokens binary", verifySchema=False)
    told = told.repartition("k").sortWithinPartitions("k")
    linked = stored(told.mapInArrow(task(lambda b: exact_links(b, least)), "place long, links long, root long"), "links")

    counted = linked.groupBy("place").agg(F.sum("links").alias("n_links"))
    joined = components(stored(linked.where("root <> place").select(F.col("root").alias("a"), F.col("place").alias("b")).distinct(), "stars"))
    of_rep = classes.select("sig", "rep", "copies", F.col("rep.place").alias("place"))
    roots = of_rep.join(joined.withColumnRenamed("node", "place"), "place", "left").join(counted, "place", "left")
    roots = stored(roots.select("sig", "rep", "copies", "n_links", F.coalesce("root", "place").alias("root")), "roots")
    ids = roots.groupBy("root").agg(F.min("rep").alias("least"))
    result = roots.join(ids, "root").select(
        "sig", "copies", F.col("least.doc_id").alias("class_id"), F.col("least.place").alias("first"), F.col("rep.doc_id").alias("copy_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    result = stored(result, "classes")
    return join_counted(points.select("place", "doc_id", "sig", "row"), result, "sig", "copies", total).select(
        "doc_id", "class_id", "copy_id", "n_links", (F.col("place") == F.col("first")).alias("kept"), *(["row"] if row else []))


def numbered(part: int, rows, work):
    n = 0
    for row in rows:
        yield from work(part, n, [row])
        n += 1


def at_home(home: Homes, points: DataFrame, sent: DataFrame, work):
    """work(partition, row, value, text) for each (place, value) of `sent`, where the text is."""
    counts = points.groupBy(F.shiftright("place", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).rdd.map(
        lambda r: ((r[0], COUNT), r[1]))
    messages = sent.rdd.map(lambda r: ((r[0] >> 33, r[0] & LOW), (r[0] & LOW, [tuple(x) for x in r[1]])))

    def run(part, row, rows, values):
        for at, value in values:
            yield from work(part, at, value, rows[at - row][1])

    return home.receive(messages.union(counts), run)
