import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import evaluation, fusion, models
from tessera.operators import vectors as S


def table(spark, *rows):
    return spark.createDataFrame([(i, [float(x) for x in v], label) for i, (v, label) in enumerate(rows)], "row long, v array<float>, label string")


def test_search_votes_and_centroids(spark):
    rows = table(spark, ([1, 0], "Rick Owens"), ([0.9, 0.1], "Rick Owens"), ([0, 1], "Prada"), ([-1, 0], ""), ([0, 0], "zero"))
    q = spark.createDataFrame([(100, [2.0, 0.0]), (101, [0.0, 3.0]), (102, None)], "row long, v array<double>")
    hits = S.top_k(q, rows, 3, "row", "v", row_cols=("label",))
    got = [tuple(r)[:4] for r in hits.filter("query_id = 100").orderBy("rank").collect()]
    assert got == [(100, 1, 0, 1.0), (100, 2, 1, 0.9939), (100, 3, 2, 0.0)]
    best = {r["query_id"]: r["label"] for r in S.votes(hits, F.col("label")).filter("place = 1").collect()}
    assert best == {100: "Rick Owens", 101: "Prada"}
    c = {r["label"]: r["centroid"] for r in S.centroids(rows, "label", "v").collect()}
    assert abs(math.hypot(*c["Rick Owens"]) - 1) < 1e-9 and c["zero"] == [0.0, 0.0]
    near = S.nearest_prototypes(q.filter("v IS NOT NULL"), S.centroids(rows, "label", "v"), "row", "v", k=1).collect()
    assert {(r["id"], r["label"]) for r in near} == {(100, "Rick Owens"), (101, "Prada")}
    with pytest.raises(ValueError):
        S.nearest_prototypes(q, S.centroids(rows, "label", "v"), "row", "v", most=2)
    assert S.top_k(q.limit(0), rows, 3, "row", "v").count() == 0


def test_many_query_blocks_are_one_search(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(80)], "row long, v array<double>")
    whole = sorted(map(tuple, S.top_k(rows, rows, 5, "row", "v", exclude_self=True).collect()))
    monkeypatch.setattr(S, "QUERY_BLOCK", 9)
    assert sorted(map(tuple, S.top_k(rows, rows, 5, "row", "v", exclude_self=True).collect())) == whole
    assert all(r[0] != r[2] for r in whole) and len(whole) == 400


def test_accuracy_and_splits(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (np.eye(8)[i % 3] + rng.normal(0, 0.05, 8)).tolist(), str(i % 3), f"{i % 3}|{i % 5}") for i in range(60)]
    df = spark.createDataFrame(rows, "row long, v array<double>, label string, grp string")
    parts = evaluation.split(df, F.col("grp"), 0.2)
    held = {r["grp"] for r in parts.filter("held_out").collect()}
    assert len(held) == 3 and not held & {r["grp"] for r in parts.filter("NOT held_out").collect()}
    voted = S.votes(S.top_k(parts.filter("held_out"), parts.filter("NOT held_out"), 5, "row", "v", row_cols=("label",)), F.col("label"), round_first=False)
    acc = S.top_k_accuracy(voted, parts.filter("held_out").select(F.col("row").alias("query_id"), F.col("label").alias("true_label"))).first()
    assert acc["top1"] > 0.9 and acc["top1"] <= acc["top3"] <= acc["top5"]
    assert evaluation.split(df, F.col("row"), 0.001).filter("held_out").count() == 1
    hits = spark.createDataFrame([(i, h) for i, h in enumerate([1, 1, 0, 1, 0])], "id long, h int")
    ci = evaluation.bootstrap_ci(hits, F.col("h"), 300).first()
    assert 0 <= ci["lo"] <= ci["hi"] <= 1
    assert tuple(evaluation.bootstrap_ci(hits.limit(0), F.col("h")).first()) == (0.0, 0.0)


def test_fusion(spark):
    rows = [(0, r, x) for r, x in enumerate("abcd", 1)] + [(1, r, x) for r, x in enumerate("baef", 1)]
    lists = spark.createDataFrame(rows, "list_id int, rank int, item string")
    got = [r["item"] for r in fusion.reciprocal_rank_fusion(lists).orderBy("place").collect()]
    assert got[:2] == ["a", "b"] and len(got) == 6
    assert fusion.reciprocal_rank_fusion(lists, top_k=2).count() == 2
    assert fusion.reciprocal_rank_fusion(lists.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fusion.reciprocal_rank_fusion(lists, k=-1)


def test_heads(spark):
    eye, zero = V.matrix([[1, 0], [0, 1]]), F.array(F.lit(0.0), F.lit(0.0))
    e = spark.createDataFrame([([1.0, 1.0],)], "e array<double>")
    high, low = (e.select(V.relu_mlp(F.col("e"), eye, zero, F.array(F.lit(w), F.lit(w)), 0.0).alias("s")).first()["s"] for w in (10.0, -10.0))
    assert high > 0.9 and abs(low - 1 / (1 + math.exp(20))) < 1e-12
    assert [r["s"] for r in spark.createDataFrame([(0.005,), (0.125,), (0.995,)], "x double").select(V.score_100(F.col("x")).alias("s")).collect()] == [0, 12, 100]
    m = models.pair_metrics(spark.createDataFrame([(2.0, 1.0), (0.0, 1.0)], "a double, b double"), "a", "b").first()
    assert m["accuracy"] == 0.5 and abs(m["loss"] - (math.log1p(math.exp(-1)) + math.log1p(math.exp(1))) / 2) < 1e-12


def test_temporal_network_shapes():
    rng = np.random.default_rng(2)
    h, n = 3, 4
    shape = {"wg": (2, h), "bg": (h,), "w1": (h, h), "b1": (h,), "w2": (h, 1), "b2": (1,)} | {f"w{k}": (h, h) for k in "zrhqkv"} | {f"u{k}": (h, h) for k in "zrh"} | {f"b{k}": (h,) for k in "zrh"}
    p = {k: rng.normal(size=s) for k, s in shape.items()}
    out = models.temporal_forward(np.zeros((n, n)), rng.normal(size=(5, n, 2)), p)
    assert out.shape == (n,) and ((out > 0) & (out < 1)).all()
    with pytest.raises(ValueError):
        models.temporal_forward(np.zeros((n, n)), np.zeros((5, n + 1, 2)), p)


def test_language_model_interface(spark):
    rows = spark.createDataFrame([(1, "say hi"), (2, "boom"), (3, None)], "id int, p string")

    class Failing(models.EchoModel):
        def complete(self, prompt, system="", max_tokens=512):
            if "boom" in prompt:
                raise RuntimeError("no answer")
            return super().complete(prompt, system, max_tokens)

    got = {r["id"]: r["reply"] for r in models.completed(rows, "p", Failing({"hi": "hello"}, "?")).collect()}
    assert got == {1: "hello", 2: "", 3: "?"}


def test_losses_refuse_one_batch_of_everything(spark, monkeypatch):
    monkeypatch.setattr(models, "BATCH_ROWS", 3)
    rows = spark.createDataFrame([(i, [1.0, float(i)], [1.0, float(i)]) for i in range(5)], "id int, image array<double>, text array<double>")
    with pytest.raises(ValueError):
        models.info_nce(rows)
    assert models.info_nce(rows, batch=F.col("id") % 2).first()["loss"] >= 0


def test_best_of_tiles_with_ties_and_gaps():
    rng = np.random.default_rng(3)
    scores = np.round(rng.normal(size=(7, 60)), 1)  # many ties
    scores[0, :57], scores[1, :], scores[2, 5] = -np.inf, np.nan, np.nan
    ids = rng.permutation(60)
    best = S.Best(7, 4)
    for start in range(0, 60, 11):
        for first in (0, 3, 6):
            best.add(scores[first : first + 3, start : start + 11], ids[start : start + 11], first)
    got = sorted(zip(best.query.tolist(), (-best.score).tolist(), best.row.tolist()))
    want = [sorted((q, -s, i) for s, i in zip(scores[q].tolist(), ids.tolist()) if s > -np.inf)[:4] for q in range(7)]
    assert got == [x for some in want for x in some]


def test_a_block_of_queries_takes_little_memory(spark):
    """Before, a full block met a batch of 10,000 rows in matrices of 330 MB each."""
    import tracemalloc

    rng = np.random.default_rng(4)
    q, m, best = rng.normal(size=(S.QUERY_BLOCK, 8)), rng.normal(size=(10_000, 8)), S.Best(S.QUERY_BLOCK, 12)
    tracemalloc.start()
    for start in range(0, len(m), S.TILE[1]):
        for first in range(0, len(q), S.TILE[0]):
            part = m[start : start + S.TILE[1]]
            best.add(np.round(q[first : first + S.TILE[0]] @ part.T, 10), np.arange(start, start + len(part)), first)
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
    assert len(best.row) == 12 * len(q)


@pytest.mark.parametrize("k", [1, 3])
def test_best_rounds_what_it_keeps_and_own_rows_are_found_by_order(k):
    """Scores that differ after the tenth place are ties, which go to the smaller id, in whatever tile it comes."""
    rng = np.random.default_rng(k)
    scores = rng.choice([0.5, 0.5 + 3e-12, 0.5 - 3e-11, 0.4, np.nan, -np.inf], (6, 90)) + 0.0
    scores[5], ids, best = np.nan, rng.permutation(90), S.Best(6, k)
    for at in range(0, 90, 30):
        best.add(scores[:, at : at + 30].copy(), ids[at : at + 30], 0, 10)
    want = []
    for q in range(5):
        told = np.nan_to_num(np.round(scores[q], 10), nan=-np.inf)
        want += [(q, int(ids[i]), told[i]) for i in np.lexsort((ids, -told))[:k]]
    assert list(zip(best.query.tolist(), best.row.tolist(), best.score.tolist())) == want
    a, b = rng.integers(0, 9, 12), rng.integers(0, 9, 15)
    found = list(zip(*(x.tolist() for x in S.same_ids(a, b))))
    assert sorted(found) == [(i, j) for i in range(12) for j in range(15) if a[i] == b[j]]
