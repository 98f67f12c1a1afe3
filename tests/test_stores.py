"""Sources with an early stop, the keyed store, the fitted encoder, stratified batches, paths for many pairs."""

import gzip
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import encoders, graph, training
from tessera.sources import files, keyed_store
from tessera.sources.lines import read_lines
from tessera.sources.storage import shared_path


def parquet_files(spark, path, parts=6, rows=50):
    for p in range(parts):
        spark.range(p * rows, (p + 1) * rows).selectExpr("id AS doc_id", "IF(id % 10 = 3, 'en', 'de') AS lang", "CAST(id AS STRING) AS text").coalesce(1).write.mode("append").parquet(f"{path}/{p:02d}")


def test_first_rows_opens_only_the_files_it_needs(spark, tmp_path):
    root = tmp_path / "t"
    root.mkdir()
    parquet_files(spark, tmp_path / "src")
    for p in range(6):
        (part,) = (tmp_path / "src" / f"{p:02d}").glob("*.parquet")
        part.rename(root / f"{p:02d}.parquet")
    got = files.first_rows(spark, str(root), 70)
    assert [r["doc_id"] for r in got.orderBy("doc_id").collect()] == list(range(70)) and len(got.inputFiles()) == 2
    english = files.first_rows(spark, str(root), 7, F.col("lang") == "en")
    assert sorted(r["doc_id"] for r in english.collect()) == [3, 13, 23, 33, 43, 53, 63] and len(english.inputFiles()) == 2
    assert files.first_rows(spark, str(root), 10_000).count() == 300 and files.first_rows(spark, str(root), 0).count() == 0
    assert files.first_rows(spark, str(root), 5, F.col("lang") == "xx").collect() == []
    (root / "05.parquet").write_bytes(b"no table")  # what is behind the last row is never opened
    assert files.first_rows(spark, str(root), 50).count() == 50


def test_lines_stop_early_and_filters_close_files(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"{i}.txt").write_text("".join(f"{i}-{k}\n" for k in range(10)))
    (tmp_path / "9.jsonl.gz").write_bytes(gzip.compress(b'{"a": 1}\n\n'))
    every = read_lines(spark, str(tmp_path))
    assert every.count() == 42 and every.rdd.getNumPartitions() == 5
    first = [(r["line"], r["value"]) for r in read_lines(spark, str(tmp_path), 23).collect()]
    assert first == [(k, f"{i}-{k}") for i in range(3) for k in range(10)][:23]
    (tmp_path / "5.txt.gz").write_bytes(b"no archive")
    assert read_lines(spark, str(tmp_path), 40).count() == 40  # the broken file is behind the limit
    one = every.filter(F.col("path") == f"{tmp_path}/2.txt")
    assert [r["value"] for r in one.collect()] == [f"2-{k}" for k in range(10)]
    with pytest.raises(Exception, match="archive|gzip|Not a gzipped"):
        read_lines(spark, str(tmp_path)).collect()
    assert read_lines(spark, str(tmp_path), 0).count() == 0
    with pytest.raises(Exception, match="FileNotFound|nowhere"):
        read_lines(spark, str(tmp_path / "nowhere")).collect()


def triples(spark, ids):
    rows = [(i, f"s{i}", "known_for", f"o{i}", "brand", "style", "t", f"s{i}", f"o{i}") for i in ids]
    return spark.createDataFrame(rows, "ord long, subject string, relation string, object string, subject_type string, object_type string, source string, subject_key string, object_key string")


def test_inserts_read_only_pieces_that_may_hold_a_key(spark):
    store = keyed_store.triple_store(spark, shared_path(spark, "store"), buckets=8)
    assert store.rows().count() == 0
    assert store.insert(triples(spark, range(2000))) == (2000, 0)
    added, read = store.insert(triples(spark, range(5000, 5006)))  # new keys: a filter errs once in a hundred
    assert added == 6 and read <= 2
    added, read = store.insert(triples(spark, [7, 7, 9_000]))
    assert added == 1 and 1 <= read <= 2  # the piece that holds key 7, of all that there are
    assert store.filters().count() > 8
    assert store.insert(triples(spark, [*range(2000), *range(5000, 5006), 9_000]))[0] == 0
    assert store.rows().count() == 2007 and store.rows().select("subject_key").distinct().count() == 2007
    for i in range(4):
        store.insert(triples(spark, range(20_000 + 100 * i, 20_100 + 100 * i)))
    before = store.filters().count()
    assert store.compact(most=3) > 0 and store.filters().count() < before
    assert store.rows().count() == 2407 and store.insert(triples(spark, [7, 20_001]))[0] == 0
    assert store.compact(most=3) == 0 and store.insert(triples(spark, []))[0] == 0
    assert sorted(store.rows().columns) == sorted(triples(spark, [1]).columns)


def test_bloom_filters_never_miss():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63 - 1, 5000)
    bits = keyed_store.bloom(keys)
    assert keyed_store.may_hold(bits, keys).all()
    assert keyed_store.may_hold(bits, rng.integers(-(2**63), 2**63 - 1, 20_000)).mean() < 0.02
    assert len(bits) <= 8 + 10 * 5000 // 8 + 1


def test_encoder_state_and_vectors(spark):
    texts = {1: "red coat red", 2: "blue coat", 3: "silk scarf, red!", 4: None, 5: "", 6: "coat coat", 7: "zzz"}
    docs = spark.createDataFrame([(*r, "x") for r in texts.items()] + [(None, "red", "x")], "doc_id long, text string, feature string")
    model = encoders.fit_tfidf(docs)
    path = shared_path(spark, "tfidf")
    model.save(path)
    again = encoders.load_tfidf(spark, path)
    assert (again.n, again.features) == (7, encoders.FEATURES)
    got = {r["id"]: sorted(s["weight"] for s in r["vector"]) for r in again.encode(docs).collect()}
    df = Counter(w for t in texts.values() for w in set((t or "").replace(",", "").replace("!", "").split()))
    for i, t in texts.items():
        tf = Counter((t or "").replace(",", "").replace("!", "").split())
        x = [n * math.log(8 / (df[w] + 1)) for w, n in tf.items()]
        norm = math.sqrt(sum(v * v for v in x))
        assert got[i] == pytest.approx(sorted(v / norm for v in x)), i
    near = encoders.nearest_texts(model.encode(docs.filter("doc_id = 2")), model.encode(docs), 2, exclude_self=True)
    assert [(r["rank"], r["row_id"]) for r in near.orderBy("rank").collect()][0] == (1, 6)
    assert encoders.fit_tfidf(docs.limit(0)).encode(docs.limit(0)).collect() == []


def test_batches_hold_every_label_alike(spark):
    rows = spark.createDataFrame([(i, "abc"[0 if i % 3 else 1 + i % 2], [float(i), 1.0]) for i in range(600)] + [(600, None, [1.0, 1.0])], "id long, label string, v array<double>")
    weights = spark.createDataFrame([(x, x, 1.0) for x in "abcd"] + [("a", "b", 0.25)], "a string, b string, weight double")
    labels, matrix = training.label_matrix(rows, "label", weights)
    assert labels == ["a", "b", "c"] and matrix.tolist() == [[1, 0.25, 0], [0, 1, 0], [0, 0, 1]]
    dealt = training.stratified_batches(rows, labels, 50).collect()
    assert len(dealt) == 12 and sorted(x[0] for r in dealt for x in r["v"]) == [float(i) for i in range(600)]
    for k in range(3):
        n = [Counter(r["labels"])[k] for r in dealt]
        assert max(n) - min(n) <= 1
    with pytest.raises(ValueError):
        training.label_matrix(rows, "label", weights, most=2)


def test_projection_learns_and_loss_falls(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, f"l{i % 4}", [*(2.0 * (np.arange(4) == i % 4) + 0.4 * rng.normal(size=4)).tolist(), *(3 * rng.normal(size=4)).tolist()]) for i in range(300)], "id long, label string, v array<double>")
    weights = spark.createDataFrame([(f"l{i}", f"l{i}", 1.0) for i in range(4)], "a string, b string, weight double")
    w, best = training.train_projection(rows, weights, None, "id", "label", "v", batch=100, epochs=15, rate=0.05)
    before, after = training.projection_losses(rows, weights, [np.eye(8), w], "id", "label", "v", batch=100)
    assert after < before and best == pytest.approx(-after)
    one = training.projected(rows.filter("id = 7"), w, "id", "v").first()
    x = w @ np.array(rows.filter("id = 7").first()["v"])
    assert one["v"] == pytest.approx((x / np.linalg.norm(x)).tolist())
    with pytest.raises(ValueError):
        training.train_projection(rows.limit(0), weights, None, "id", "label", "v")


def graph_of(spark, edges):
    rows = [(i, f"N{a}", "associated_with", f"N{b}", f"n{a}", f"n{b}") for i, (a, b) in enumerate(edges)]
    return spark.createDataFrame(rows, "ord long, subject string, relation string, object string, subject_key string, object_key string")


def walked(edges, src, dst, most):
    """The breadth-first tree's paths by their definition, as trails of edge numbers."""
    level, seen = [((), src)], {src}
    for _ in range(most):
        moves = [(trail + (i,), b) for trail, at in level for i, (x, y) in enumerate(edges) for a, b in ((x, y), (y, x)) if a == at]
        if hits := sorted(t for t, b in moves if b == dst):
            return hits
        best = {}
        for t, b in sorted(moves):
            if b not in seen:
                best.setdefault(b, t)
        level, seen = [(t, b) for b, t in best.items()], seen | set(best)
    return []


def test_paths_of_many_pairs_are_the_trees_paths(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(45)] + [(0, i) for i in range(30, 60)]  # a hub
    edges = [(a, b) for a, b in edges if a != b]
    pairs = [(a, b) for a in (1, 5, 31, 40) for b in (0, 7, 12, 45, 31)]
    asked = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs], "src string, dst string")
    got = {}
    for r in graph.paths_between(graph_of(spark, edges), asked, 3).collect():
        got.setdefault((r["src"], r["dst"]), []).append(tuple(r["trail"]))
    for a, b in pairs:
        assert sorted(got.get((f"n{a}", f"n{b}"), [])) == (walked(edges, a, b, 3) if a != b else []), (a, b)


def test_a_hub_is_expanded_towards_its_targets_only(spark, monkeypatch):
    """1,000 nodes hang on a hub: two levels from one of them list its path, not the thousand."""
    edges = [(0, i) for i in range(1, 1001)]
    sizes, plain = [], graph.materialise

    def counted(df, name):
        out = plain(df, name)
        if name == "frontier":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "materialise", counted)
    asked = spark.createDataFrame([("n1", "n2")], "src string, dst string")
    assert graph.paths_between(graph_of(spark, edges), asked, 3).count() == 1
    assert sum(sizes) <= 2


def test_near_texts_against_brute_force_without_a_join_of_pairs(spark):
    """Texts that share words with all others: pairs are scored where the rows are, and no row for a pair is shuffled."""
    rng = random.Random(8)
    docs = spark.createDataFrame([(f"t{i:02}", " ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(0, 30)))) for i in range(60)] + [("t07", "a second row b"), ("t61", None)], "doc_id string, text string").repartition(3)
    told = encoders.fit_tfidf(docs).encode(docs).cache()
    near = encoders.nearest_texts(told.filter("id < 't20'"), told, 4, exclude_self=True)
    assert "Join" not in near._jdf.queryExecution().toString()
    vectors = {r["id"]: {s["feature"]: s["weight"] for s in r["vector"]} for r in told.collect()}
    want = []
    for q in sorted(x for x in vectors if x < "t20"):
        sims = sorted((-round(sum(w * vectors[o].get(f, 0.0) for f, w in vectors[q].items()), 8), o) for o in vectors if o != q and set(vectors[q]) & set(vectors[o]))
        want += [(q, i, o, round(-s, 4)) for i, (s, o) in enumerate(sims[:4], 1)]
    assert sorted((r["query_id"], r["rank"], r["row_id"], round(r["score"], 4)) for r in near.collect()) == want
    assert len(vectors["t07"]) >= 2 and vectors["t61"] == {}


def test_shares_of_queries_hold_a_bounded_table(monkeypatch):
    monkeypatch.setattr(encoders, "ABREAST", 8)
    monkeypatch.setattr(encoders, "TABLE", 40)
    ends = np.arange(0, 101, 5)  # 20 queries of 5 features each, none in common
    cuts = encoders.shares(ends, np.arange(100))
    assert [c[0] for c in cuts[1:]] == [c[1] for c in cuts[:-1]] and (cuts[0][0], cuts[-1][1]) == (0, 20)
    assert all((b - a) ** 2 * 5 <= 40 for a, b in cuts)


@pytest.mark.parametrize("dense", [0, 1 << 30])  # no tile is dense, every one is
def test_near_texts_sum_few_pairs_and_miss_none(monkeypatch, dense):
    """Common words are summed for pairs within reach only, or for all of a tile; the best are those of brute force."""
    for name, value in (("COMMON", 12), ("GROUPS", 4), ("ABREAST", 7), ("PAIRS", 5), ("DENSE", dense)):
        monkeypatch.setattr(encoders, name, value)
    rng = np.random.default_rng(4)
    chance = 1 / (2 + np.arange(200))
    rows = (rng.random((400, 200)) < chance) * rng.random((400, 200)) * -np.log(chance)
    rows[5] = 0
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
    asked, told = rows[:20], lambda m: ((m > 0).sum(1), np.nonzero(m)[1], m[m > 0])
    size, found, weight = told(asked)
    block, best, scored = encoders.Asked(np.concatenate([[0], np.cumsum(size)]), found, weight), encoders.Best(20, 3), 0
    for at in range(0, 400, 40):
        for first, s in block.scores(*told(rows[at : at + 40]), best.least):
            scored += int(np.isfinite(s).sum())
            best.add(s, np.arange(at, at + len(s[0])), first)
    sims = np.round(asked @ rows.T, 8)
    want = [(q, r) for q in range(20) for r in np.lexsort((np.arange(400), -sims[q]))[:3] if sims[q, r] > 0]
    assert list(zip(best.query.tolist(), best.row.tolist())) == want and 5 not in best.query
    assert dense or scored < 0.5 * (sims > 0).sum()
