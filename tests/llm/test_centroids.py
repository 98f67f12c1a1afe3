"""Centroid clustering: against a plain loop in whole numbers, and what the bounds save."""

import hashlib
import random

import numpy as np
import pytest

from tessera.llm import centroids as C
from tessera.llm.common import table

SF = "/root/testdata/sf0.001"


def plain(rows, k, rounds, size, scale=1024):
    """[(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)] by the definition, without bounds."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: ((1, "") if r[0] is None else (0, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest()), r[1]))[:k]
    centroids = [list(v) for _, v in first]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own) if o == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine)]
    ends = [(i, *nearest(v)) for i, v in kept]
    each = {n: sum(d for _, d, o in ends if o == n) for n in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, o, d, each[o], sum(each.values()), digest[o]) for i, d, o in ends]


def same(got, wanted):
    assert sorted(map(tuple, got), key=repr) == sorted(wanted, key=repr)


def test_clusters_of_the_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, SF, "embeddings").collect()]
    same(C.cluster(table(spark, SF, "embeddings")).collect(), plain(rows, 8, 10, 64))


@pytest.mark.parametrize("k,spread", [(1, 1.0), (3, 0.05), (9, 0.3), (40, 0.02)])
def test_clusters_of_made_vectors(spark, k, spread):
    rng = np.random.default_rng(k)
    middle = rng.normal(size=(7, 4))
    rows = [(i, (middle[i % 7] + spread * rng.normal(size=4)).tolist()) for i in range(500)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(500, 520)]  # ties and repeated vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    same(C.cluster(df, k=k, rounds=6, size=4).collect(), plain(rows, k, 6, 4))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, 0.2]), (1, [0.1, 0.2]), (2, None), (3, []), (4, [0.1]), (5, [nan, 0.0]), (6, [inf, 0.0]), (7, [None, 0.0]), (None, [0.3, -0.2]), (8, [0.1, 0.2, 0.3]), (9, [-0.001, 90_000.0])]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, cluster int")
    same(C.cluster(df, k=3, rounds=3, size=2).collect(), plain(rows, 3, 3, 2))
    same(C.cluster(df, k=30, rounds=3, size=2).collect(), plain(rows, 30, 3, 2))
    assert C.cluster(df.limit(0), size=2).collect() == []
    with pytest.raises(Exception, match="27 bits"):
        C.cluster(spark.createDataFrame([(1, [1e6]), (2, [1e300])], "vec_id long, embedding array<double>"), size=1).collect()


def test_bounds_save_measurements_and_change_nothing():
    rng = np.random.default_rng(5)
    middle = rng.integers(-900, 900, (32, 16))
    vecs = middle[rng.integers(0, 32, 3000)] + rng.integers(-40, 40, (3000, 16))
    centroids = vecs[random.Random(1).sample(range(3000), 32)]
    group = C.grouped(centroids, 8)
    b = C.first_assignment(vecs, centroids, group)
    measured = 0
    for _ in range(8):
        new = np.stack([b.sums[c, :-1] // b.sums[c, -1] if b.sums[c, -1] else centroids[c] for c in range(32)])
        drift = np.sqrt(((new - centroids) ** 2).sum(1).astype(float))
        centroids = new
        measured += C.reassign(b, centroids, drift, group)
        d = C.squared(vecs, centroids)
        assert (b.own == d.argmin(1)).all()
        for c in range(32):
            assert (b.sums[c, :-1] == vecs[b.own == c].sum(0)).all() and b.sums[c, -1] == (b.own == c).sum()
    assert measured < 0.25 * 8 * 3000 * 32  # a plain scan measures all
