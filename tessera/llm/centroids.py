"""Centroid clustering with Yinyang bounds, in whole numbers.

The centroids are put into groups once. A vector keeps an upper bound of the distance to its own centroid and one lower
bound a group of the distance to that group's other centroids; a round moves the bounds by what the centroids moved.
Where the upper bound lies below every lower bound, nothing is measured (global filter); else only groups whose bound it
reaches are looked at (group filter), and in them only centroids that their own movement may have brought near enough.
Those are measured exactly, in whole numbers, so bounds save work and never change a result: they are compared with a
margin far above their rounding, and what is within it is measured.

The vectors are packed into blocks of rows, each with its bounds and with the sums of its clusters, which only vectors
that change their cluster alter. A round maps blocks to blocks, without a shuffle, and writes them to shared storage; what
goes to the driver is k sums, however many vectors there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialise

#: Vectors of a block.
BLOCK = 4096
#: Centroids that share a lower bound.
GROUP = 4
#: Components below this keep squared distances within 62 bits for up to 64 components.
LARGEST = 2**27
#: Bounds are rounded a few times in 16 digits; what is nearer than this share is measured.
SLACK = 1e-9

STATE = "ids array<long>, v binary, own binary, upper binary, lower binary, sums array<long>"


class ComponentRange(ValueError):
    """A scaled component is beyond 27 bits: distances would not fit 64 bits."""


def kept_vectors(vectors: DataFrame, scale: int, size: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): vectors of ``size`` components, none null or not finite, as floor(scale * x)."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.floor(F.least(F.greatest(scale * c.cast("double"), F.lit(-9e18)), F.lit(9e18))))
    return vectors.filter((F.size(x) == size) & finite).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def squared(vecs: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances [vector, centroid]."""
    most = max(int(np.abs(vecs).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if most >= LARGEST:
        raise ComponentRange("components beyond 27 bits: take a smaller scale or smaller components")
    if 4 * vecs.shape[1] * most * most < 2**53:  # whole numbers that doubles hold exactly
        a, b = vecs.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((vecs - c) ** 2).sum(1) for c in centroids], axis=1)


def grouped(centroids: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """A group for each centroid: a few rounds of clustering of the centroids themselves."""
    groups = max(1, min(groups, len(centroids)))
    at = centroids[np.linspace(0, len(centroids) - 1, groups).astype(int)].astype(np.float64)
    of = np.zeros(len(centroids), dtype=np.int64)
    for _ in range(rounds):
        of = ((centroids[:, None, :] - at[None]) ** 2).sum(2).argmin(1)
        at = np.stack([centroids[of == g].mean(0) if (of == g).any() else at[g] for g in range(groups)])
    return np.unique(of, return_inverse=True)[1]


@dataclass
class Block:
    """Vectors with their clusters and bounds; sums holds, for each cluster, its vectors' sums and their number."""

    v: np.ndarray
    own: np.ndarray
    upper: np.ndarray
    lower: np.ndarray
    sums: np.ndarray


def first_assignment(vecs: np.ndarray, centroids: np.ndarray, group: np.ndarray) -> Block:
    """Every vector is measured against every centroid."""
    d = squared(vecs, centroids)
    own = d.argmin(1)  # the first of equals
    rows = np.arange(len(vecs))
    root = np.sqrt(d.astype(np.float64))
    upper = root[rows, own]
    root[rows, own] = np.inf
    lower = np.stack([root[:, group == g].min(1) for g in range(group.max() + 1)], axis=1)
    sums = np.zeros((len(centroids), vecs.shape[1] + 1), dtype=np.int64)
    moved(sums, vecs, own, 1)
    return Block(vecs, own, upper, lower, sums)


def moved(sums: np.ndarray, vecs: np.ndarray, clusters: np.ndarray, sign: int) -> None:
    for c in np.unique(clusters):
        at = clusters == c
        sums[c, :-1] += sign * vecs[at].sum(0)
        sums[c, -1] += sign * int(at.sum())


def reassign(b: Block, centroids: np.ndarray, drift: np.ndarray, group: np.ndarray) -> int:
    """Assigns the block's vectors to the nearest of ``centroids``, which moved by ``drift``; returns the distances measured."""
    farthest = np.array([drift[group == g].max() for g in range(group.max() + 1)])
    before = b.lower
    b.upper = b.upper + drift[b.own]
    b.lower = before - farthest[None, :]
    reach = b.upper * (1 + SLACK) + SLACK
    open_ = np.nonzero(reach >= b.lower.min(1))[0]
    if not len(open_):
        return 0
    exact = np.zeros(len(open_), dtype=np.int64)
    for c in np.unique(b.own[open_]):  # the upper bound becomes the distance itself
        at = b.own[open_] == c
        exact[at] = squared(b.v[open_[at]], centroids[c : c + 1])[:, 0]
    b.upper[open_] = np.sqrt(exact.astype(np.float64))
    measured = len(open_)
    left = b.upper[open_] * (1 + SLACK) + SLACK >= b.lower[open_].min(1)
    open_, exact = open_[left], exact[left]
    if not len(open_):
        return measured
    old, best, best_d = b.own[open_], b.own[open_].copy(), exact.copy()
    reach = b.upper[open_] * (1 + SLACK) + SLACK
    looked = b.lower[open_] <= reach[:, None]  # [vector, group]
    value = np.full((len(open_), len(centroids)), np.inf)  # distances, or bounds of what is passed over
    for c in range(len(centroids)):
        rows = np.nonzero(looked[:, group[c]] & (old != c))[0]
        bound = before[open_[rows], group[c]] - drift[c]
        value[rows, c] = bound
        rows = rows[bound <= reach[rows]]
        if len(rows):
            d = squared(b.v[open_[rows]], centroids[c : c + 1])[:, 0]
            measured += len(rows)
            value[rows, c] = np.sqrt(d.astype(np.float64))
            nearer = (d < best_d[rows]) | ((d == best_d[rows]) & (c < best[rows]))
            best[rows[nearer]], best_d[rows[nearer]] = c, d[nearer]
    rows = np.arange(len(open_))
    value[rows, old] = b.upper[open_]
    value[rows, best] = np.inf  # a group's bound leaves the vector's own centroid out
    for g in range(group.max() + 1):
        low = value[:, group == g].min(1)
        b.lower[open_, g] = np.where(looked[:, g], low, np.minimum(b.lower[open_, g], low))
    b.upper[open_] = np.sqrt(best_d.astype(np.float64))
    change = old != best
    if change.any():
        vecs = b.v[open_[change]]
        moved(b.sums, vecs, old[change], -1)
        moved(b.sums, vecs, best[change], 1)
        b.own[open_] = best
    return measured


def packed(ids: pa.Array, b: Block) -> pa.RecordBatch:
    one = lambda a, t: pa.array([a.astype(t).tobytes()], pa.binary())
    ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    columns = [ids, one(b.v, np.int32), one(b.own, np.int32), one(b.upper, np.float64), one(b.lower, np.float64), pa.array([b.sums.ravel().tolist()], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, names=["ids", "v", "own", "upper", "lower", "sums"])


def unpacked(batches: Iterator[pa.RecordBatch], size: int, k: int, groups: int) -> Iterator[tuple[pa.Array, Block]]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids, v, own, upper, lower, sums = (c[i] for c in batch.columns)
            read = lambda x, t: np.frombuffer(x.as_py(), dtype=t)
            yield ids.values, Block(read(v, np.int32).astype(np.int64).reshape(-1, size), read(own, np.int32).astype(np.int64), read(upper, np.float64), read(lower, np.float64).reshape(-1, groups), np.asarray(sums.values).reshape(k, size + 1).copy())


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, size: int = 64, seed: str = "3", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that is kept.

    Kept are vectors of exactly ``size`` components, none null or not finite, each taken as floor(scale * x). Centroids
    start as the k kept vectors of least sha256 of "seed:vec_id" (ties by the vector itself); fewer vectors make fewer
    centroids. ``rounds`` times every vector goes to its nearest centroid, the smaller number of equals, and centroids
    become the floor of their vectors' mean, empty ones stay; then vectors are assigned once more. Rows with a null id
    are vectors like others but come last as first centroids; repeated rows count each. An empty table gives an empty
    result; other columns are not read. Components of 2**27 and more after scaling fail with ``ComponentRange``.
    """
    spark = vectors.sparkSession
    rows = kept_vectors(vectors, scale, size, id_col, vector_col)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last()
    first = [r["v"] for r in rows.orderBy(order, "v").limit(k).collect()]
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    centroids = np.array(first, dtype=np.int64)
    k = len(centroids)
    group = grouped(centroids, -(-k // GROUP))
    groups = int(group.max()) + 1

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                vecs = np.asarray(part.column(1).flatten()).reshape(-1, size)
                yield packed(part.column(0), first_assignment(vecs, centroids, group))

    state = materialise(rows.mapInArrow(start, STATE), "clusters")
    for _ in range(rounds):
        each = state.select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        sums = dict(map(tuple, each.collect()))  # k sums of ``size`` components
        total = [[int(sums[c * (size + 1) + i]) for i in range(size + 1)] for c in range(k)]
        new = np.array([[x // t[-1] for x in t[:-1]] if t[-1] else list(centroids[c]) for c, t in enumerate(total)], dtype=np.int64)
        drift = np.sqrt(((new - centroids) ** 2).sum(1).astype(np.float64))
        centroids = new

        def step(batches: Iterator[pa.RecordBatch], centroids=centroids, drift=drift) -> Iterator[pa.RecordBatch]:
            for ids, block in unpacked(batches, size, k, groups):
                reassign(block, centroids, drift, group)
                yield packed(ids, block)

        before, state = state, materialise(state.mapInArrow(step, STATE), "clusters")
        discard(before)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, b in unpacked(batches, size, k, groups):
            d = ((b.v - centroids[b.own]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(b.own.astype(np.int32)), pa.array(d)], names=["vec_id", "cluster", "distance"])

    out = materialise(state.mapInArrow(told, "vec_id long, cluster int, distance long"), "assigned")
    discard(state)
    inertia = {r[0]: int(r[1]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = lambda values, kind: F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("cluster") + 1)
    return out.select("vec_id", "cluster", "distance", of([inertia.get(c) for c in range(k)], "long").alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), of(digests, "string").alias("centroid_sha256"))
