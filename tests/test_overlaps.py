"""Set overlaps by blocks, intervals by one draw a resample, the temporal network over tables, approximate search."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cells, evaluation, models, overlaps, supervision
from tessera.operators import vectors as S
from tessera.sources.storage import shared_path


def brute(owned):
    sets = {}
    for o, c in owned:
        if o is not None and c is not None:
            sets.setdefault(o, set()).add(c)
    names = sorted(sets)
    return {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for i, a in enumerate(names) for b in names[i + 1 :] if sets[a] & sets[b]}


@pytest.mark.parametrize("block,columns", [(512, 8192), (7, 5)])
def test_jaccard_by_blocks(spark, monkeypatch, block, columns):
    monkeypatch.setattr(overlaps, "BLOCK", block)
    rng = random.Random(block)
    owned = [(f"o{i:02d}", f"c{rng.randrange(30)}") for i in range(40) for _ in range(rng.randrange(12))] + [("o01", "c1")] * 3 + [(None, "c1"), ("o02", None)]
    df = spark.createDataFrame(owned, "owner string, concept string")
    wanted = brute(owned)
    got = {(r["a"], r["b"]): r["jaccard"] for r in overlaps.jaccard_pairs(df).collect()}
    assert got == pytest.approx(wanted) and overlaps.jaccard_total(df).first()["j"] == pytest.approx(sum(wanted.values()))
    for t in (0.2, 0.5, 1.0):
        above = {(r["a"], r["b"]): r["jaccard"] for r in overlaps.similar_owners(df, t).collect()}
        assert above == pytest.approx({k: v for k, v in wanted.items() if v >= t})
    assert overlaps.jaccard_pairs(df.limit(0)).collect() == [] and overlaps.jaccard_total(df.limit(0)).first()["j"] == 0 and overlaps.similar_owners(df.limit(0)).collect() == []
    numbers = df.select(F.substring("owner", 2, 9).cast("long").alias("owner"), "concept")
    assert overlaps.jaccard_pairs(numbers).count() == len(wanted)
    with pytest.raises(ValueError):
        overlaps.similar_owners(df, 0)


def test_counts_go_through_many_columns(monkeypatch):
    monkeypatch.setattr(overlaps, "COLUMNS", 3)
    sets = [np.array(sorted(random.Random(i).sample(range(20), i % 9))) for i in range(15)]
    assert overlaps.shared_counts(sets, sets).tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]


def test_a_common_concept_lists_no_pairs(spark):
    owned = spark.createDataFrame([(i, "every") for i in range(300)] + [(i, f"own{i}") for i in range(300)], "owner long, concept string")
    plan = overlaps.similar_owners(owned, 0.9)
    assert plan.collect() == []
    assert overlaps.jaccard_total(owned).first()["j"] == pytest.approx(300 * 299 / 2 / 3)


def test_signal_report_detects_overlap(spark):
    looks = spark.createDataFrame([(1, "a", "s"), (2, "b", "s"), (3, "c", "t")], "row long, designer string, show string")
    owned = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("z", "x")], "owner string, concept string")
    r = supervision.signal_report(looks, owned).first()
    assert (r["n_images"], r["n_designers"], r["n_collections"], r["images_without_concepts"]) == (3, 3, 3, 1)
    assert (r["unique_concepts"], r["shared_concepts"], r["mean_jaccard"]) == (2, 1, round(0.5 / 3, 3))


# -- intervals


def test_binomial_draws_follow_the_distribution():
    for n, won in ((1, 1), (5, 0), (10, 3), (400, 17), (10_000_000, 2_345_678)):
        draws = evaluation.binomial_draws(n, won, 4000, 1)
        p = won / n
        assert draws.min() >= 0 and draws.max() <= n
        assert abs(draws.mean() - won) <= 5 * math.sqrt(max(n * p * (1 - p), 1e-9) / 4000) + 1e-9
        assert abs(draws.std() - math.sqrt(n * p * (1 - p))) <= 0.08 * math.sqrt(n * p * (1 - p)) + 1e-9


def test_intervals_cover_the_truth(spark):
    rng, covered = np.random.default_rng(3), 0
    for trial in range(300):
        n = 200
        won = int((rng.random(n) < 0.3).sum())
        lo, hi = np.percentile(evaluation.binomial_draws(n, won, 500, trial) / n, [2.5, 97.5])
        covered += lo <= 0.3 <= hi
    assert 0.9 <= covered / 300 <= 0.99
    rows = spark.createDataFrame([(i, float(x)) for i, x in enumerate(rng.normal(5, 2, 2000))] + [(-1, None)], "id long, x double")
    r = evaluation.bootstrap_mean_ci(rows, F.col("x"), F.col("id"), 400).first()
    se = 2 / math.sqrt(2000)
    assert r["lo"] < r["mean"] < r["hi"] and 0.8 * 3.92 * se < r["hi"] - r["lo"] < 1.2 * 3.92 * se
    again = evaluation.bootstrap_mean_ci(rows.repartition(7), F.col("x"), F.col("id"), 400).first()
    assert tuple(again) == pytest.approx(tuple(r))
    assert tuple(evaluation.bootstrap_mean_ci(rows.limit(0), F.col("x"), F.col("id"), 20).first()) == (0.0, 0.0, 0.0)


# -- temporal network


def test_temporal_scores_against_the_network_in_memory(spark):
    rng, h, n, t = np.random.default_rng(2), 3, 12, 5
    shape = {"wg": (2, h), "bg": (h,), "w1": (h, h), "b1": (h,), "w2": (h, 1), "b2": (1,)} | {f"w{k}": (h, h) for k in "zrhqkv"} | {f"u{k}": (h, h) for k in "zrh"} | {f"b{k}": (h,) for k in "zrh"}
    p = {k: rng.normal(size=s) for k, s in shape.items()}
    x, a = rng.normal(size=(t, n, 2)), np.triu((rng.random((n, n)) < 0.3).astype(float), 1)
    a += a.T
    x[1, 3] = 0  # a node without a row in a season
    rows = [(10 * i, j, x[i, j].tolist()) for i in range(t) for j in range(n) if (i, j) != (1, 3)] + [(None, 1, [1.0, 1.0]), (10, None, [1.0, 1.0])]
    snapshots = spark.createDataFrame(rows, "t int, node long, x array<double>")
    links = spark.createDataFrame([(int(i), int(j)) for i, j in zip(*np.nonzero(a))] * 2 + [(4, 4), (None, 1)], "src long, dst long")
    got = {r["node"]: r["score"] for r in models.temporal_scores(snapshots, links, p).collect()}
    assert [got[i] for i in range(n)] == pytest.approx(models.temporal_forward(a, x, p).tolist()) and len(got) == n
    assert models.temporal_scores(snapshots.limit(0), links, p).collect() == []
    with pytest.raises(ValueError):
        models.temporal_scores(snapshots.withColumn("x", F.array(F.lit(1.0))), links, p)


# -- cells


def test_cells_find_what_exact_search_finds(spark):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(40, 16))
    rows = [(i, (middle[i % 40 if i % 3 else 0] + 0.25 * rng.normal(size=16)).tolist(), i % 7) for i in range(3000)]  # a third of all rows in one cell
    rows += [(3000, None, 1), (3001, [], 1), (3002, [float("nan")] * 16, 1), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell int").repartition(4)
    path = shared_path(spark, "cells")
    built = cells.build_index(df, path, cells=32, sample=2000)
    index = cells.open_index(spark, path)
    assert (index.probe, index.recall) == (built.probe, built.recall) and index.recall >= 0.95 and index.rows().count() == 3000
    asked = df.filter("vec_id % 50 = 0")
    exact = S.top_k(asked.filter("vec_id < 3000"), df.filter("vec_id < 3000"), 10, "vec_id", "embedding", exclude_self=True)
    found = cells.search(index, asked, 10, exclude_self=True)
    told = cells.recall(found, exact).first()
    assert told["wanted"] == 600 and told["recall"] >= 0.9
    share = cells.candidates(index, asked).agg(F.avg("candidates")).first()[0] / 3000
    assert share < 0.6
    every = cells.search(index, asked, 10, probe=10_000, exclude_self=True)
    assert sorted(map(tuple, every.select("query_id", "rank", "row_id", "score").collect())) == sorted(map(tuple, exact.select("query_id", "rank", "row_id", "score").collect()))


def test_blocks_of_cells_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(400)], "vec_id long, embedding array<double>")
    index = cells.build_index(df, shared_path(spark, "cells"), cells=4)
    whole = sorted(map(tuple, cells.search(index, df, 5).collect()))
    monkeypatch.setattr(cells, "BLOCK_ROWS", 16)
    monkeypatch.setattr(cells, "BLOCK_QUERIES", 16)
    assert sorted(map(tuple, cells.search(index, df, 5).collect())) == whole
    empty = cells.build_index(df.limit(0), shared_path(spark, "cells"))
    assert cells.search(empty, df, 5).collect() == [] and cells.candidates(empty, df).collect() == []


def test_owners_of_equal_sets_are_one_class(spark, monkeypatch):
    """Nearly all owners have one set here: only classes are compared, and every pair of owners comes out once."""
    monkeypatch.setattr(overlaps, "SHARE", 7)
    sets = {f"o{i:03}": "abcdefghij" if i % 20 else "abcdefghi" if i % 40 else "xyz" for i in range(120)}
    owned = spark.createDataFrame([(o, c) for o, s in sets.items() for c in s], "owner string, concept string")
    members, firsts = overlaps.classes(owned)
    assert members.count() == 120 and sorted(r["owner"] for r in firsts.select("owner").distinct().collect()) == ["o000", "o001", "o020"]
    want = {(a, b): len(set(x) & set(y)) / len(set(x) | set(y)) for a, x in sets.items() for b, y in sets.items() if a < b and set(x) & set(y)}
    for found in (overlaps.jaccard_pairs(owned), overlaps.similar_owners(owned, 0.8)):
        rows = found.collect()
        assert len(rows) == len(want) and {(r["a"], r["b"]): round(r["jaccard"], 9) for r in rows} == {k: round(v, 9) for k, v in want.items()}
    assert overlaps.jaccard_total(owned).first()["j"] == pytest.approx(sum(want.values()))


@pytest.mark.parametrize("find", [overlaps.jaccard_pairs, overlaps.similar_owners])
def test_values_are_rounded_once_for_two_classes_and_few_pairs_wait_in_memory(spark, find):
    """Two sets of 45 owners each: rounded before the owners are paired, whose pairs come in small shares."""
    owned = spark.createDataFrame([(f"o{i:03}", c) for i in range(90) for c in ("abcdef", "abcdefg")[i % 2]], "owner string, concept string")
    found = find(owned, digits=3)
    assert {(r["jaccard"], r["n"]) for r in found.groupBy("jaccard").agg(F.count("*").alias("n")).collect()} == {(0.857, 45 * 45), (1.0, 45 * 44)}
    tree = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = [i for i, line in enumerate(tree) if "Generate explode(left" in line]
    assert at and all(i > at[0] for i, line in enumerate(tree) if "round(" in line)
    assert overlaps.SHARE**2 <= 1 << 16
