"""Complete-linkage clustering of row vectors without a distance matrix.

Clusters that merge up to a height have all their members within it, so these merges need no pair of clusters that is
further apart. Each pass finds the pairs of clusters up to a limit, chosen from a sample of clusters so that about
FINISH² / 2 pairs come, and one task merges these, all that are nearest to each other at once, until none is left: for
complete linkage this builds the same tree as merging one pair at a time. The next pass has fewer clusters and a higher
limit, the last one has none. Where so many pairs are equally far that no limit parts them, a round without limit finds
the nearest cluster of every cluster and merges all pairs that are nearest to each other.

A task compares one block of members with one block of members. Products tell which pairs of members may be the furthest
of two clusters; these are taken again by differences, so no distance has the rounding of a product. A cluster larger
than a block is cut into parts, whose partial maxima are combined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattweave.operators.knn import exact_gaps, matrix
from wattweave.sources.shared import discard, rewritten, shuffles_dropped

BLOCK_ROWS = 16_384
#: Rows of a block of a round without limit, which holds the distances of all rows of two blocks.
SEARCH_ROWS = 2_048
#: Rows of a block while there are few, so that several tasks share them, and how many blocks there then are at most.
LEAST_ROWS, LEAST_BLOCKS = 256, 8
#: Tasks of a round at most; the driver keeps a record of each. A task then has several pairs of blocks, one at a time.
MOST_TASKS = 1_000
#: Clusters whose table of distances one task merges: four million distances, whatever the number of rows.
FINISH = 2_896
#: Times that number a pass may find before it counts as one that no limit parts.
MOST_FOUND = 3
#: Clusters of the sample that a limit is chosen from, and its pairs below the limit, at least.
SAMPLE, SAMPLE_BELOW = 512, 100
#: Rows of a product: about a tile of so many by so many. Larger clusters are cut, so a tile has four times that at most.
TILE_ROWS, TILE_COLUMNS, UNIT_ROWS = 256, 2_048, 1_024
#: Pairs of members whose differences are held at once.
EXACT_PAIRS = 8_192


def complete_linkage(rows: DataFrame, key: str, block_rows: int = BLOCK_ROWS, finish: int = FINISH) -> DataFrame:
    """The merge tree of rows with complete ``features``: (kept, gone, height, step).

    A cluster is named by its smallest key; ``gone`` joins ``kept``. Equal rows merge first, at height zero. One task
    merges about as many pairs of clusters as ``finish`` clusters have; both sizes steer cost and memory, never the tree.
    """
    with shuffles_dropped(rows.sparkSession):
        return _tree(rows, key, block_rows, max(finish * (finish - 1) // 2, 1))


def _tree(rows: DataFrame, key: str, block_rows: int, most: int) -> DataFrame:
    keyed = rows.select(F.col(key).cast("long").alias("key"), "features")
    members = rewritten(keyed.groupBy("features").agg(F.min("key").alias("key"))
                          .select("key", "features", F.col("key").alias("cluster")))
    copies = (keyed.join(members.select("features", "cluster"), "features").where(F.col("key") != F.col("cluster"))
              .select(F.col("cluster").alias("kept"), F.col("key").alias("gone"), F.lit(0.0).alias("height"),
                      F.lit(0).alias("step")))
    tree = [copies]
    n, left = members.agg(F.count(F.lit(1)), F.count_distinct("cluster")).first()
    step, wider, first = 0, 1, members
    while left > 1:
        pairs = left * (left - 1) // 2
        if pairs <= most:
            limit = math.inf
        else:
            limit = _limit(members, n, left, block_rows, most * wider, step) if most * wider < pairs else None
        found = None if limit is None else rewritten(_close_pairs(members, n, block_rows, limit))
        if found is None or found.count() > MOST_FOUND * most:
            limit = None
            nearest = _mutual_pairs(rewritten(_search(members, members, n, min(block_rows, SEARCH_ROWS))))
            merges = rewritten(nearest.withColumn("step", F.lit(step + 1)).withColumn("top", F.col("kept")))
        else:
            merges = rewritten(_merged(found, step))
        if found is not None:
            discard(found)
        n_merges, last = merges.agg(F.count(F.lit(1)), F.max("step")).first()
        if not n_merges and limit is not None and math.isfinite(limit):  # the sample's limit was below all distances
            wider *= 4
            continue
        if not n_merges:  # two of the least distance are each other's nearest, unless a distance is no number
            raise ValueError("features have values that are no numbers")
        tree.append(merges.drop("top"))
        left, step, wider = left - n_merges, last, 1
        if left > 1:
            renamed = merges.select(F.col("gone").alias("cluster"), "top")
            before, members = members, rewritten(members.join(renamed, "cluster", "left")
                                                   .select("key", "features", F.coalesce("top", "cluster").alias("cluster")))
            if before is not first:  # the copies' merges still read those
                discard(before)
    out = tree[0]
    for part in tree[1:]:
        out = out.unionByName(part)
    return out


def _limit(members: DataFrame, n: int, left: int, block_rows: int, most: int, seed: int) -> float | None:
    """The distance up to which about ``most`` pairs of the ``left`` clusters lie, from all pairs of a sample of them.

    None if far more pairs lie at the least distance.
    """
    share = most / (left * (left - 1) / 2)
    sampled = min(max(SAMPLE, math.ceil(math.sqrt(2 * SAMPLE_BELOW / share))), left)
    of = 1 << 40
    some = members.where(F.pmod(F.xxhash64("cluster", F.lit(seed)), F.lit(of)) < math.ceil(of * sampled / left))
    gaps = _meet_blocks(some, some, max(math.ceil(n * sampled / left), 1), block_rows, _block_gaps,
                        "one long, other long, distance double", half=True)
    gaps = rewritten(gaps.groupBy("one", "other").agg(F.max("distance").alias("distance")))
    k = max(round(share * gaps.count()), 1)
    limit = gaps.orderBy("distance").limit(k).agg(F.max("distance")).first()[0]
    at, below = gaps.agg(F.count_if(F.col("distance") <= limit), F.max(F.when(F.col("distance") < limit, F.col("distance")))).first()
    discard(gaps)
    if limit is None:  # no two clusters in the sample
        return 0.0
    return below if at > MOST_FOUND * k else limit


def _close_pairs(members: DataFrame, n: int, block_rows: int, limit: float) -> DataFrame:
    """(one, other, distance) of all pairs of clusters with all their members within the limit."""
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        return _block_close(left, right, limit)

    found = _meet_blocks(members, members, n, block_rows, work,
                         "one long, other long, distance double, pairs long, whole long", half=True)
    return (found.groupBy("one", "other").agg(F.max("distance").alias("distance"), F.sum("pairs").alias("pairs"),
                                              F.max("whole").alias("whole"))
            .where(F.col("pairs") == F.col("whole")).drop("pairs", "whole"))


def _merged(found: DataFrame, done: int) -> DataFrame:
    """All merges of the clusters that the pairs found allow; ``top`` is the cluster that ``gone`` ends in."""
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _merge_all(pa.Table.from_batches(list(batches), _PAIRS), done).to_batches()

    return found.repartition(1).mapInArrow(merge, "kept long, gone long, height double, step int, top long")


_PAIRS = pa.schema([("one", pa.int64()), ("other", pa.int64()), ("distance", pa.float64())])


def _merge_all(table: pa.Table, done: int) -> pa.Table:
    """Merge all pairs that are nearest to each other, round by round; a pair that was not found is beyond the limit."""
    gaps = table.column("distance").to_numpy()
    named = pa.chunked_array([*table.column("one").chunks, *table.column("other").chunks], pa.int64()).combine_chunks().dictionary_encode()
    keys = named.dictionary.to_numpy()
    n, order = len(keys), np.argsort(keys)
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    keys, ij = keys[order], place[named.indices.to_numpy()]
    i, j = ij[:len(gaps)], ij[len(gaps):]
    merges, top = [], np.arange(n, dtype=np.int32)
    while len(i):
        a, b, height = _mutual(i, j, gaps, n)
        done += 1
        merges.append((a, b, height, np.full(len(a), done)))
        renamed, parts = np.arange(n, dtype=np.int32), np.ones(n, np.int8)
        renamed[b], parts[a] = a, 2
        top = renamed[top]
        i, j = renamed[i], renamed[j]
        i, j = np.minimum(i, j), np.maximum(i, j)
        need = parts[i] * parts[j]
        same, joined = (need == 1), (need > 1) & (i != j)
        # of a merged cluster, all parts must have been found; the furthest counts
        pair = i[joined].astype(np.int64) * n + j[joined]
        order = np.argsort(pair)
        pair, far = pair[order], gaps[joined][order]
        starts = np.flatnonzero(np.diff(pair, prepend=-1))
        found = np.diff(starts, append=len(pair))
        far = np.maximum.reduceat(far, starts) if len(starts) else far
        x, y = np.divmod(pair[starts], n)
        whole = found == parts[x] * parts[y]
        i, j = np.concatenate([i[same], x[whole].astype(np.int32)]), np.concatenate([j[same], y[whole].astype(np.int32)])
        gaps = np.concatenate([gaps[same], far[whole]])
    kept, gone, height, at = (np.concatenate(x) for x in zip(*merges)) if merges else (np.empty(0, int) for _ in range(4))
    return pa.table({"kept": pa.array(keys[kept], pa.int64()), "gone": pa.array(keys[gone], pa.int64()),
                     "height": pa.array(height, pa.float64()), "step": pa.array(at, pa.int32()),
                     "top": pa.array(keys[top[gone]], pa.int64())})


def _mutual(i: np.ndarray, j: np.ndarray, gaps: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs whose sides are each other's nearest; of equally near clusters the one named first is the nearest."""
    least, near = np.full(n, np.inf), np.full(n, n, np.int32)
    np.minimum.at(least, i, gaps)
    np.minimum.at(least, j, gaps)
    of_i, of_j = gaps == least[i], gaps == least[j]
    np.minimum.at(near, i[of_i], j[of_i])
    np.minimum.at(near, j[of_j], i[of_j])
    some = np.flatnonzero(of_i & of_j)
    some = some[(near[i[some]] == j[some]) & (near[j[some]] == i[some])]
    return i[some], j[some], gaps[some]


def _mutual_pairs(near: DataFrame) -> DataFrame:
    other = near.select(F.col("cluster").alias("near"), F.col("near").alias("back"))
    return (near.join(other, "near").where((F.col("back") == F.col("cluster")) & (F.col("cluster") < F.col("near")))
            .select(F.col("cluster").alias("kept"), F.col("near").alias("gone"), F.col("distance").alias("height")))


def _meet_blocks(asked: DataFrame, members: DataFrame, n: int, block_rows: int, work, columns: str, half: bool = False) -> DataFrame:
    """work on each block of the asked rows with each block of all members; with ``half``, on each two blocks once."""
    blocks = max(math.ceil(n / block_rows), min(LEAST_BLOCKS, math.ceil(n / LEAST_ROWS)), 1)

    def placed(df: DataFrame) -> DataFrame:
        parts = (df.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
                 .withColumn("parts", F.ceil(F.col("size") * blocks / n).cast("int")))
        part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("key"), "parts")).otherwise(0)
        return (df.join(parts, "cluster")
                .select("cluster", "features", "size", "parts",
                        F.pmod(F.xxhash64("cluster", part), F.lit(blocks)).cast("int").alias("block")))

    first, last = F.lit(0), F.lit(blocks - 1)
    left = placed(asked).withColumnRenamed("block", "a").withColumn("b", F.explode(F.sequence(F.col("a") if half else first, last)))
    right = placed(members).withColumnRenamed("block", "b").withColumn("a", F.explode(F.sequence(first, F.col("b") if half else last)))
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # both sides descend from one frame
    tasks = min(blocks * blocks, MOST_TASKS)  # stated, as few bytes make much work here and would be put in one task
    left, right = left.repartition(tasks, "a", "b"), right.repartition(tasks, "a", "b")
    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(work, columns)


def _search(asked: DataFrame, members: DataFrame, n: int, block_rows: int) -> DataFrame:
    found = _meet_blocks(asked, members, n, block_rows, _block_linkage, "cluster long, near long, distance double, final boolean")
    found = found.where("final").select("cluster", "near", "distance").unionByName(
        found.where(~F.col("final")).groupBy("cluster", "near").agg(F.max("distance").alias("distance")))
    return found.groupBy("cluster").agg(
        F.min_by(F.struct("near", "distance"), F.struct("distance", "near")).alias("best")).select(
        "cluster", "best.near", "best.distance")


def _linked(left: pa.Table, right: pa.Table):
    """Clusters of two blocks with their parts, and the largest distance between members of each two of them."""
    a, a_starts, a_parts, x = _sorted_block(left)
    b, b_starts, b_parts, y = _sorted_block(right)
    gaps = np.concatenate([np.maximum.reduceat(exact_gaps(y, x[i:i + 64]).T, b_starts, axis=1) for i in range(0, len(x), 64)])
    gaps = np.maximum.reduceat(gaps, a_starts, axis=0)
    gaps[a[:, None] == b[None, :]] = np.inf
    return a, a_parts, b, b_parts, gaps


def _block_gaps(left: pa.Table, right: pa.Table) -> pa.Table:
    """Every two clusters of the blocks, the smaller name first, with the largest distance between their members here."""
    return _block_close(left, right, math.inf).select(["one", "other", "distance"])


def _block_close(left: pa.Table, right: pa.Table, limit: float) -> pa.Table:
    """Every two clusters of the blocks whose members here are all within the limit, the smaller name first.

    With the largest distance, how many pairs of members it is of, and how many the two clusters have in all; a large
    cluster gives several rows. A block that meets itself has its pairs once.
    """
    parts = []
    if left.num_rows and right.num_rows:
        itself = left.column("a")[0] == left.column("b")[0]
        a = _Units.of(left)
        b = a if itself else _Units.of(right)
        # products round by so much at most
        slack = 4 * (a.rows.shape[1] + 4) * np.finfo(float).eps * max(a.squares.max(), b.squares.max())
        ones = (np.ones((len(x.rows), 1)) for x in (a, b))
        p, q = np.hstack([-2 * a.rows, a.squares[:, None], next(ones)]), np.hstack([b.rows, next(ones), b.squares[:, None]])
        columns = b.tiles(TILE_COLUMNS)
        for one in a.tiles(TILE_ROWS):
            for other in columns:
                if not itself or one[0] < other[1] - 1:
                    parts.append(_tile(a, b, one, other, p, q, limit, slack, itself))
    empty = [np.empty(0, t) for t in (np.int64, np.int64, float, np.int64, np.int64)]
    return pa.table(dict(zip(("one", "other", "distance", "pairs", "whole"), map(np.concatenate, zip(empty, *parts)))))


@dataclass
class _Units:
    """The rows of a block by unit, the smallest first. A unit is a cluster, or a piece of UNIT_ROWS of a larger one."""

    names: np.ndarray
    whole: np.ndarray
    starts: np.ndarray
    rows: np.ndarray
    squares: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> _Units:
        clusters = table.column("cluster").to_numpy()
        order = np.argsort(clusters, kind="stable")
        clusters = clusters[order]
        first = np.flatnonzero(np.concatenate([[True], clusters[1:] != clusters[:-1]]))
        sizes = np.diff(first, append=len(clusters))
        pieces = -(-sizes // UNIT_ROWS)
        starts = np.repeat(first, pieces) + UNIT_ROWS * _counted(pieces)
        sizes = np.diff(starts, append=len(clusters))
        by_size = np.argsort(sizes, kind="stable")
        names, whole = clusters[starts[by_size]], table.column("size").to_numpy()[order][starts[by_size]]
        sizes, starts = sizes[by_size], starts[by_size]
        rows = matrix(table.column("features"))[order][np.repeat(starts, sizes) + _counted(sizes)]
        return cls(names, whole, np.concatenate([[0], np.cumsum(sizes)]), rows, (rows * rows).sum(1))

    def tiles(self, rows: int) -> list[tuple[int, int]]:
        """Runs of units, first and end, that have about so many rows, or one unit that has more."""
        out, at = [], 0
        while at < len(self.names):
            end = max(int(np.searchsorted(self.starts, self.starts[at] + rows, "right")) - 1, at + 1)
            out.append((at, end))
            at = end
        return out


def _counted(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each of the sizes."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _most(gaps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The largest of each unit's rows, column by column; sizes ascend, so units of one size go together."""
    if sizes[-1] == 1:
        return gaps
    out, at = np.empty((len(sizes), gaps.shape[1])), 0
    borders = np.flatnonzero(np.diff(sizes, prepend=0, append=0))
    for first, end in zip(borders, borders[1:]):
        size, n = sizes[first], end - first
        some = gaps[at:at + size * n].reshape(n, size, -1)
        some.max(axis=1, out=out[first:end])
        at += size * n
    return out


def _tile(a: _Units, b: _Units, one: tuple[int, int], other: tuple[int, int], p: np.ndarray, q: np.ndarray,
          limit: float, slack: float, itself: bool) -> tuple[np.ndarray, ...]:
    """The rows of _block_close for units of both sides."""
    a_starts, b_starts = a.starts[one[0]:one[1] + 1], b.starts[other[0]:other[1] + 1]
    a_from, b_from = a_starts[0], b_starts[0]
    gaps = p[a_from:a_starts[-1]] @ q[b_from:b_starts[-1]].T
    a_sizes, b_sizes = np.diff(a_starts), np.diff(b_starts)
    by_row = _most(gaps, a_sizes)
    most = by_row.T if b_sizes[-1] == 1 else _most(np.ascontiguousarray(by_row.T), b_sizes)
    near = most <= limit * limit * (1 + 1e-12) + slack
    if b_sizes[-1] == 1:
        r, c = np.divmod(np.flatnonzero(near.T), len(b_sizes))
    else:
        c, r = np.divmod(np.flatnonzero(near), len(a_sizes))
    a_names, b_names = a.names[one[0] + r], b.names[other[0] + c]
    apart = a_names != b_names
    if itself:
        apart &= one[0] + r < other[0] + c
    r, c, a_names, b_names = r[apart], c[apart], a_names[apart], b_names[apart]
    distance = np.empty(len(r))
    few = max(EXACT_PAIRS // int(max(a_sizes.max(), b_sizes.max())), 1) if len(r) else 1
    for at in range(0, len(r), few * 8):
        u, v = r[at:at + few * 8], c[at:at + few * 8]
        least = most[v, u] - 2 * slack
        # columns of the second unit, then rows of the first, that may be the furthest apart
        pair = np.repeat(np.arange(len(u)), b_sizes[v])
        y = (b_starts[v] - b_from)[pair] + _counted(b_sizes[v])
        far = by_row[u[pair], y] >= least[pair]
        pair, y = pair[far], y[far]
        sizes = a_sizes[u[pair]]
        x = np.repeat((a_starts[u[pair]] - a_from), sizes) + _counted(sizes)
        pair, y = np.repeat(pair, sizes), np.repeat(y, sizes)
        far = gaps[x, y] >= least[pair]
        pair, x, y = pair[far], x[far], y[far]
        exact = np.empty(len(pair))
        for k in range(0, len(pair), EXACT_PAIRS):
            gap = a.rows[a_from + x[k:k + EXACT_PAIRS]] - b.rows[b_from + y[k:k + EXACT_PAIRS]]
            exact[k:k + EXACT_PAIRS] = np.sqrt((gap * gap).sum(1))
        distance[at:at + few * 8] = np.maximum.reduceat(exact, np.flatnonzero(np.diff(pair, prepend=-1)))
    near = distance <= limit
    r, c = r[near], c[near]
    a_names, b_names = a_names[near], b_names[near]
    return (np.minimum(a_names, b_names), np.maximum(a_names, b_names), distance[near], a_sizes[r] * b_sizes[c],
            a.whole[one[0] + r] * b.whole[other[0] + c])


def _block_linkage(left: pa.Table, right: pa.Table) -> pa.Table:
    """Largest member distance per pair of clusters in two blocks: per cluster the nearest one whose distance is
    final, and every pair of which one side has parts elsewhere."""
    empty = {"cluster": pa.array([], pa.int64()), "near": pa.array([], pa.int64()),
             "distance": pa.array([], pa.float64()), "final": pa.array([], pa.bool_())}
    if not (left.num_rows and right.num_rows):
        return pa.table(empty)
    a, a_parts, b, b_parts, gaps = _linked(left, right)
    partial = (a_parts[:, None] > 1) | (b_parts[None, :] > 1)
    whole = np.where(partial, np.inf, gaps)
    best = whole.argmin(1)
    at = np.arange(len(a))
    kept = np.isfinite(whole[at, best])
    rows, cols = np.nonzero(partial & np.isfinite(gaps))
    return pa.table({
        "cluster": pa.array(np.concatenate([a[kept], a[rows]])),
        "near": pa.array(np.concatenate([b[best[kept]], b[cols]])),
        "distance": pa.array(np.concatenate([whole[at, best][kept], gaps[rows, cols]])),
        "final": pa.array(np.concatenate([np.ones(kept.sum(), bool), np.zeros(len(rows), bool)]))})


def _sorted_block(table: pa.Table):
    clusters = table.column("cluster").to_numpy()
    order = np.argsort(clusters, kind="stable")
    names, starts = np.unique(clusters[order], return_index=True)
    return names, starts, table.column("parts").to_numpy()[order][starts], matrix(table.column("features"))[order]


def cut_tree(rows: DataFrame, key: str, tree: DataFrame, k: int) -> DataFrame:
    """(key, cluster): the k clusters left after undoing the k - 1 highest merges, numbered by their smallest key."""
    tree = rewritten(tree)  # it is read twice, and a lazy tree would be built as often
    undone = tree.orderBy(F.desc("height"), F.desc("step"), F.desc("gone")).limit(k - 1).select("gone")
    links = tree.join(undone, "gone", "left_anti").select(F.col("gone").alias("node"), F.col("kept").alias("up"))
    nodes = rows.select(F.col(key).cast("long").alias("node"))
    current = rewritten(nodes.join(links, "node", "left").withColumn("up", F.coalesce("up", "node")))
    roots = rewritten(current.where(F.col("node") == F.col("up")).select(F.col("node").alias("root")))  # k rows
    settled, waiting = None, current
    while True:
        here = waiting.join(roots, waiting["up"] == roots["root"], "left_semi")
        settled = here if settled is None else settled.unionByName(here)
        rest = waiting.join(roots, waiting["up"] == roots["root"], "left_anti")
        # jump two links at a time; rows that have reached one of the k roots stay out of the joins
        above = current.select(F.col("node").alias("up"), F.col("up").alias("top"))
        waiting = rewritten(rest.join(above, "up").select("node", F.col("top").alias("up")))
        if waiting.isEmpty():
            break
        done = current.join(F.broadcast(roots), current["up"] == roots["root"], "left_semi")
        moving = current.join(F.broadcast(roots), current["up"] == roots["root"], "left_anti")
        current = rewritten(done.unionByName(moving.join(above, "up").select("node", F.col("top").alias("up"))))
    numbered = roots.withColumn("cluster", F.row_number().over(Window.orderBy("root")))
    return settled.join(numbered, settled["up"] == numbered["root"]).select(F.col("node").alias(key), "cluster")


def hierarchical_clusters(rows: DataFrame, key: str, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Complete-linkage clusters of the rows: (key, cluster 1 … k)."""
    return cut_tree(rows, key, complete_linkage(rows, key, block_rows), k)
