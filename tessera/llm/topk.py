"""Exact top-k by inner product, block at a time.

Vectors of integers lie in id order in blocks of ``BLOCK`` rows, each with the maximum and minimum of every
component. What a block can add to a query is at most the sum over components of the query's weight times the
extreme of its sign: summed term maxima. A query visits blocks in falling order of that bound, scores them through
their rows, and stops as soon as a bound lies below its k-th best score. The first k-th score comes from a bounded
sample of rows, which is below the true one, so nothing is lost by it.

The query set goes in chunks of bounded size to all partitions, one pass over the vectors for each; a pass returns
at most k rows for each query and partition, and only those that reach the sample's k-th score.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import shared_path

BLOCK = 512
#: Blocks that are ordered against each other, queries that one pass broadcasts, rows of the threshold sample.
BLOCKS_AT_ONCE, QUERIES_AT_ONCE, SAMPLE = 64, 16_384, 4_096
#: Below every score, and its negative is a number too.
LOWEST = -(2**62)


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(uid, vec_id, v array<long>): floor(scale * x); rows with a null id, vector or component, or a component that is not finite, are left out."""
    x = F.transform(vector_col, lambda c: c.cast("double"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & fine)
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(F.lit(float(scale)) * c).cast("long")).alias("v"))


class ScoreRange(ValueError):
    """A score, or a bound of one, that a 64-bit number cannot hold."""


def matrix(lists: pa.Array, dim: int | None = None) -> np.ndarray:
    """Rows of a list column; shorter vectors are filled with zeros, which add nothing."""
    sizes = np.asarray(lists.value_lengths())
    width = max(int(sizes.max(initial=0)), dim or 0)
    flat = np.asarray(lists.flatten())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exact: in floating point where every sum fits 53 bits, else in integers."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    top = float(np.abs(a).max()) * float(np.abs(b).max()) * d
    if top < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if top < 2**62:
        return a @ b.T
    out = a.astype(object) @ b.T.astype(object)
    if max(out.max(), -out.min()) >= 2**62:
        raise ScoreRange("scores beyond 62 bits: take a smaller scale or smaller components")
    return out.astype(np.int64)


class Best:
    """The k best (score, vec_id) of each query so far; ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores = np.full((n, k), LOWEST, dtype=np.int64)
        self.ids = np.full((n, k), np.iinfo(np.int64).max, dtype=np.int64)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores [len(rows), m] of candidates ``ids``."""
        s = np.concatenate([self.scores[rows], scores], axis=1)
        i = np.concatenate([self.ids[rows], np.broadcast_to(ids, scores.shape)], axis=1)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.scores[rows], self.ids[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def search_blocks(vecs: np.ndarray, ids: np.ndarray, uids: np.ndarray, queries: np.ndarray, query_uids: np.ndarray, floor: np.ndarray, best: Best) -> int:
    """Visits the blocks of ``vecs`` for all queries in the order of their bounds; returns the scores computed."""
    starts = range(0, len(vecs), BLOCK)
    high = np.stack([vecs[a : a + BLOCK].max(axis=0) for a in starts])
    low = np.stack([vecs[a : a + BLOCK].min(axis=0) for a in starts])
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    bounds = product(up, high) + product(down, low)  # [query, block]
    order = np.argsort(-bounds, axis=1, kind="stable")
    active, scored = np.arange(len(queries)), 0
    for turn in range(bounds.shape[1]):
        block = order[active, turn]
        kth = np.maximum(best.scores[active, -1], floor[active])
        go = bounds[active, block] >= kth
        active, block = active[go], block[go]  # all later bounds of a query are lower still
        if not len(active):
            break
        for b in np.unique(block):
            rows, a = active[block == b], b * BLOCK
            part = slice(a, a + BLOCK)
            scores = product(queries[rows], vecs[part])
            scores[query_uids[rows][:, None] == uids[part][None, :]] = LOWEST + 1
            best.add(rows, scores, ids[part])
            scored += scores.size
    return scored


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of each query row's k best other rows; all, if there are fewer.

    ``is_query`` is a condition on column ``vec_id``. Rows with a null id, a null vector, or a null or non-finite
    component take no part. Repeated rows are rows of their own: each is searched for and can be found, only the
    query's own row is left out. Ties go to the smaller id. Vectors of other lengths are filled with zeros. An empty
    table or query set gives an empty result; other columns are not read. Components times ``scale`` must fit 64 bits,
    and scores and bounds 62: else the query fails with ``ScoreRange``.
    """
    spark = vectors.sparkSession
    path = shared_path(spark, "vectors")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = quantised(vectors, id_col, vector_col, scale).withColumn("tie", F.xxhash64("v"))
    laid = laid.repartitionByRange(parts, "vec_id", "tie").sortWithinPartitions("vec_id", "tie").drop("tie")
    laid.withColumn("uid", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    sample = np.zeros((0, 1), dtype=np.int64), np.zeros(0, dtype=np.int64)
    if got := rows.select("uid", "v").limit(SAMPLE).toArrow():
        sample = matrix(got["v"].combine_chunks()) if got.num_rows else sample[0], np.asarray(got["uid"])
    queries = rows.filter(is_query).select("uid", "vec_id", "v").toLocalIterator(prefetchPartitions=True)
    hits, first = f"{path}-hits", True
    schema = "query_uid long, query_id long, vec_id long, score long"
    while chunk := list(itertools.islice(queries, QUERIES_AT_ONCE)):
        q_uids, q_ids = (np.array([r[c] for r in chunk], dtype=np.int64) for c in ("uid", "vec_id"))
        q = matrix(pa.array([r["v"] for r in chunk], pa.list_(pa.int64())))
        shared = spark.sparkContext.broadcast((q, q_uids, q_ids, sample_floor(q, q_uids, *sample, k)))

        def run(batches, shared=shared):
            q, q_uids, q_ids, floor = shared.value
            best = Best(len(q), k)
            for b in batches:
                for a in range(0, b.num_rows, BLOCK * BLOCKS_AT_ONCE):
                    part = b.slice(a, BLOCK * BLOCKS_AT_ONCE)
                    search_blocks(matrix(part.column(2)), np.asarray(part.column(1)), np.asarray(part.column(0)), q, q_uids, floor, best)
            own = (best.scores > LOWEST + 1) & (best.scores >= floor[:, None])
            at, _ = np.nonzero(own)
            for a in range(0, len(at), 100_000):
                s = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q_uids[at][s], q_ids[at][s], best.ids[own][s], best.scores[own][s])], names=["query_uid", "query_id", "vec_id", "score"])

        rows.select("uid", "vec_id", "v").mapInArrow(run, schema).write.mode("overwrite" if first else "append").parquet(hits)
        first = False
    found = spark.createDataFrame([], schema) if first else spark.read.schema(schema).parquet(hits)
    rank = F.row_number().over(W.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def sample_floor(q: np.ndarray, q_uids: np.ndarray, vecs: np.ndarray, uids: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th best score over the sample: at most its true one. The lowest value if the sample is too small."""
    out = np.full(len(q), LOWEST + 1, dtype=np.int64)
    if len(vecs) <= k:
        return out
    for a in range(0, len(q), 1024):
        s = product(q[a : a + 1024], vecs)
        s[q_uids[a : a + 1024][:, None] == uids[None, :]] = LOWEST + 1
        out[a : a + 1024] = np.partition(s, len(vecs) - k, axis=1)[:, len(vecs) - k]
    return out
