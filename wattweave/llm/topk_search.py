"""Exact top-k search by inner product, reading sorted coordinate lists without random access."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 256
BLOCK_ROWS = 4_096
CHUNK_ROWS = 2_048
QUERIES_AT_ONCE = 256
LAST_UNREAD = 16
NO_ID = np.iinfo(np.int64).max
FOUND = "query long, query_id long, vec_id long, score long"


def numbered_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """row, vec_id, v and dims of the vectors that take part: not null, all components there and finite."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(F.col(vector).isNotNull() & whole)
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("vec_id"),
                       F.col(vector).alias("v"), F.size(vector).alias("dims"))


def integers(table: pa.Table, dims: int) -> np.ndarray:
    """floor(256 * x) of each component, as doubles that hold the integers exactly, or an error."""
    flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    found = np.floor(flat.reshape(table.num_rows, dims) * SCALE)
    if found.size and np.abs(found).max() >= 2.0**53:
        raise ValueError("a component of 2**45 or more has no exact score in 64 bits")
    return found


def exact_type(c: np.ndarray, q: np.ndarray):
    """Doubles where every partial sum stays below 2**53, else 64-bit integers, else an error."""
    most = (np.abs(c).max(initial=0.0) * np.abs(q).max(initial=0.0)) * max(1, c.shape[1])
    if most >= 2.0**62:
        raise ValueError("scores may pass 64 bits")
    return np.float64 if most < 2.0**53 else np.int64


def resolve(c, ids, q, pairs_of, candidates, k):
    """Final scores of (query, candidate) pairs: the k best of each query as arrays query, candidate, score."""
    score = np.empty(len(pairs_of), c.dtype)
    for a in range(0, len(score), 65_536):
        some = slice(a, a + 65_536)
        score[some] = np.einsum("ij,ij->i", q[pairs_of[some]], c[candidates[some]])
    order = np.lexsort((ids[candidates], -score, pairs_of))
    sorted_query = pairs_of[order]
    first = np.flatnonzero(np.diff(sorted_query, prepend=-1))
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    best = order[rank < k]
    return pairs_of[best], candidates[best], score[best].astype(np.int64)


def search_block(c: np.ndarray, ids: np.ndarray, rows: np.ndarray, q: np.ndarray, query_rows: np.ndarray, k: int):
    """The k best candidates of a block for each query: arrays query, candidate, score.

    The block has a sorted list per coordinate. A query reads the lists of its positive coordinates from the top and those
    of its negative ones from the bottom, all to the same depth. A candidate's upper bound takes the frontier for what
    has not been read of it, its lower bound the list's far end. What cannot reach the k-th lower bound is out; each round
    reads half of what is left. When only enough candidates are left, or the lists are nearly read, final scores of those
    that are left are resolved. Ties with the k-th bound stay in until then.
    """
    lists = np.sort(c, axis=0)
    n = len(c)
    positive, negative = np.maximum(q, 0), np.minimum(q, 0)
    alive, bound = np.arange(n), None
    open_pairs = None
    unread = n // 2
    while unread >= LAST_UNREAD and n > 4 * k:
        top, bottom, part = lists[unread], lists[n - 1 - unread], c[alive]
        upper = positive @ np.maximum(part, top).T + negative @ np.minimum(part, bottom).T
        lower = positive @ np.where(part >= top, part, lists[0]).T + negative @ np.where(part <= bottom, part, lists[-1]).T
        own = query_rows[:, None] == rows[alive][None, :]
        dead = own if open_pairs is None else own | ~open_pairs
        least = -np.inf if lower.dtype == np.float64 else np.iinfo(np.int64).min
        lower[dead] = least
        if lower.shape[1] >= k:
            kth = np.partition(lower, lower.shape[1] - k, axis=1)[:, lower.shape[1] - k]
            bound = kth if bound is None else np.maximum(bound, kth)
        still = ~dead if bound is None else (upper >= bound[:, None]) & ~dead
        keep = still.any(axis=0)
        alive, open_pairs = alive[keep], still[:, keep]
        if open_pairs.sum() <= 4 * k * len(q):
            break
        unread //= 2
    if open_pairs is None:
        open_pairs = query_rows[:, None] != rows[None, :]
    query, candidate = np.nonzero(open_pairs)
    return resolve(c, ids, q, query, alive[candidate], k)


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS,
          chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """query (its row), query_id, rank, vec_id and score: the k best candidates by inner product for each query.

    Both frames come from numbered_vectors() of one table; a query's own row is not among its candidates. Candidates are
    dealt to blocks and queries to chunks by a hash of the row; each pair of a block and a chunk is one group, whose size
    is bounded, so queries are compared with all rows and no side is broadcast. Each block's k best of a query go on to a
    ranked window. Ties go to the smaller vec_id, null last. Vectors of another length are not compared. A query without
    candidates has no rows. Scores are exact: doubles below 2**53, 64-bit integers above, an error beyond.
    """
    blocks = max(1, -(-candidates.count() // block_rows))
    chunks = max(1, -(-queries.count() // chunk_rows))

    def dealt(df: DataFrame, n: int) -> Column:
        return F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")

    def all_of(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    keys, tasks = ["dims", "block", "chunk"], max(8, 2 * blocks * chunks)
    left = candidates.withColumn("block", dealt(candidates, blocks)).withColumn("chunk", all_of(chunks)).repartition(tasks, *keys)
    right = queries.withColumn("chunk", dealt(queries, chunks)).withColumn("block", all_of(blocks)).repartition(tasks, *keys)

    def search(key, ours: pa.Table, theirs: pa.Table) -> pa.Table:
        dims, out = key[0].as_py(), []
        if ours.num_rows and theirs.num_rows:
            c, q = integers(ours, dims), integers(theirs, dims)
            kind = exact_type(c, q)
            c, q = c.astype(kind), q.astype(kind)
            ids = ours.column("vec_id").fill_null(NO_ID).to_numpy()
            rows, query_rows = ours.column("row").to_numpy(), theirs.column("row").to_numpy()
            for a in range(0, len(q), QUERIES_AT_ONCE):
                some = slice(a, a + QUERIES_AT_ONCE)
                query, candidate, score = search_block(c, ids, rows, q[some], query_rows[some], k)
                out.append((query + a, candidate, score))
        if not out:
            return pa.table({n: pa.array([], pa.int64()) for n in ("query", "query_id", "vec_id", "score")})
        query, candidate, score = (np.concatenate(x) for x in zip(*out))
        return pa.table({"query": theirs.column("row").take(pa.array(query)), "query_id": theirs.column("vec_id").take(pa.array(query)),
                         "vec_id": ours.column("vec_id").take(pa.array(candidate)), "score": pa.array(score)})

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, FOUND)
    ranked = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def nearest_rows(df: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for each vector whose vec_id is divisible by `every`.

    Null vec_ids are candidates but no queries. Vectors null, or with a component null or not finite, take no part.
    Rows with one vec_id are rows of their own, and each is a query. Empty table: no rows. Other columns are not read.
    """
    vectors = numbered_vectors(df)
    found = top_k(vectors, vectors.where(F.col("vec_id") % every == 0), k)
    return found.select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
