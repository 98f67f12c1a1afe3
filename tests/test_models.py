"""Builds, links, judges, training and what looks at pictures, with stand-in models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import prompts
from tessera.operators import capabilities, evaluation, graph, knowledge, models, perception, retrieval, supervision, training, vectors
from tessera.operators import triples as T
from tessera.sources import files, sinks

RAW = "ord long, subject string, relation string, object string, subject_type string, object_type string, source string"
FACTS = [("Prada", "based_in", "Milan"), ("Miu Miu", "part_of", "Prada"), ("Miuccia Prada", "creative_director", "Prada"), ("Raf Simons", "collaborated_with", "Miuccia Prada"), ("Jil Sander", "based_in", "Milan"), ("Raf Simons", "creative_director", "Jil Sander")]


@pytest.fixture(scope="module")
def triples(spark):
    rows = [(i, s, r, o, "brand", "brand", "test") for i, (s, r, o) in enumerate(FACTS)]
    return T.canonical_triples(spark.createDataFrame(rows, RAW)).persist()


def test_graph_is_built_from_texts_once(spark, triples):
    model = models.EchoModel({"alpha": '[{"subject":"Dior","relation":"based in","object":"Paris"},{"subject":"Prada","relation":"based_in","object":"Milan"}]', "beta": "no list"})
    docs = spark.createDataFrame([(0, "a", "x" * 2400 + " alpha"), (1, "b", "beta"), (2, "c", "alpha"), (3, "d", None)], "ord long, title string, text string")
    new, per = knowledge.build_graph(docs, model, triples)
    assert [(r["subject"], r["object"], r["source"]) for r in new.collect()] == [("Dior", "Paris", "a")]
    assert [r["added"] for r in per.orderBy("ord").collect()] == [1, 0, 0, 0]
    assert knowledge.build_stats(per).first() == (4, 1)
    assert knowledge.build_graph(docs, model, triples.unionByName(new))[0].count() == 0
    assert knowledge.build_graph(docs, model, limit=1)[1].count() == 1


def test_predicted_links_are_new_and_about_the_entity(spark, triples):
    reply = '[{"subject":"Jil Sander","relation":"based_in","object":"Milan"},{"subject":"Jil Sander","relation":"known_for","object":"minimalism"},{"subject":"Prada","relation":"known_for","object":"nylon"}]'
    names = spark.createDataFrame([(0, "Jil Sander"), (1, "Nobody")], "ord long, entity string")
    got = knowledge.predict_links(names, triples, models.EchoModel({"Jil Sander": reply}, "garbage")).collect()
    assert [(r["subject_key"], r["relation"], r["object_key"], r["source"]) for r in got] == [("jil sander", "known_for", "minimalism", "llm_predicted")]


def test_linked_looks_carry_their_facts(spark, triples):
    looks = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.0, 1.0])], "id int, v array<double>")
    prototypes = spark.createDataFrame([("Prada", [1.0, 0.0]), ("Unknown", [0.0, 1.0])], "label string, centroid array<double>")
    got = {(r["id"], r["rank"]): (r["entity"], r["facts"]) for r in knowledge.link(looks, prototypes, triples, "id", "v", 2, 2).collect()}
    assert got[1, 1] == ("Prada", ["Prada based in Milan", "Miu Miu part of Prada"]) and got[2, 1] == ("Unknown", [])
    assert set(r["label"] for r in knowledge.entity_prototypes(triples, retrieval.hashing_encoder(8), min_facts=1).collect()) <= {s for s, _, _ in FACTS}


def test_path_questions_tell_meaningful_paths_only(spark, triples):
    houses = spark.createDataFrame([(0, "Miu Miu"), (1, "Jil Sander"), (2, "Raf Simons"), (3, "Prada")], "place int, house string")
    got = {(r["a"], r["b"]): r["assistant"] for r in knowledge.path_questions(triples, houses).collect()}
    assert got["Miu Miu", "Prada"] == "They connect through the graph: Miu Miu —part_of→ Prada."
    assert ("Jil Sander", "Prada") not in got  # they share a city, which tells nothing, and no other path is as short
    assert got["Raf Simons", "Prada"].count("—") == 2
    assert knowledge.path_questions(triples, houses, max_pairs=1).count() == 1
    for src, dst in (("Miu Miu", "Milan"), ("Raf Simons", "Prada")):
        one = graph.shortest_paths(triples, src, dst).collect()
        pair = spark.createDataFrame([(src.lower(), dst.lower())], "src string, dst string")
        assert sorted(map(str, (r["path"] for r in one))) == sorted(map(str, (r["path"] for r in graph.paths_between(triples, pair).collect())))
    assert graph.edges(triples).count() == len(FACTS)


def test_lift_and_a_judge_that_prefers_facts(spark, triples):
    class Judge:
        def complete(self, prompt, system="", max_tokens=512):
            if "Answer A:" not in prompt:
                return prompt
            a, b = prompt.split("Answer A:")[1].split("Answer B:")
            return "A longer one wins.\nVERDICT: " + ("A" if len(a) > len(b) else "B")

    rows = knowledge.answers_of_arms(triples, Judge(), n_entities=3, judge=True)
    assert {r["judge"] for r in rows.collect()} == {"kg"} and all(r["coverage_kg"] == 1.0 for r in rows.collect())
    told = knowledge.lift_summary(rows).first()
    assert (told["entities_tested"], told["judge_kg"], told["judge_rag"]) == (3, 3, 0) and told["lift"] == told["mean_coverage_kg"] - told["mean_coverage_rag"]
    assert knowledge.lift_summary(rows.limit(0)).first()["lift"] == 0.0
    store = retrieval.build_store(spark.createDataFrame([(0, 0, "s", "Prada is a house in Milan. " * 12)], "ord long, doc_id long, source string, text string"), retrieval.hashing_encoder())
    assert knowledge.answers_of_arms(triples, Judge(), store, n_entities=2).count() == 2


def test_prompts_hold_what_is_asked(spark):
    row = spark.createDataFrame([("t" * 9000, "src", "Prada", ["f1", "f2"], ["coat"], "work")], "t string, s string, e string, f array<string>, g array<string>, o string")
    made = {
        "x": prompts.extraction(F.col("t"), F.col("s")), "p": prompts.prediction(F.col("e"), F.col("f"), 3), "l": prompts.look(F.col("e"), F.col("s")), "j": prompts.judgement(F.lit("q"), F.lit("one"), F.lit("two")),
        "a": prompts.grounded_answer(F.lit("q"), F.lit("")), "t": prompts.topic_analysis(F.lit("capes"), F.lit("k")), "b": prompts.brand_foundation(F.create_map(F.lit("aesthetic"), F.lit("calm")), F.lit("k")), "r": prompts.look_review(F.col("g"), F.col("o"), F.col("f"), F.lit("k")),
    }
    got = row.select(*(m.alias(k) for k, m in made.items())).first().asDict()
    assert all([m["role"] for m in ms] == ["system", "user"] for ms in got.values())
    user = {k: ms[1]["content"] for k, ms in got.items()}
    assert user["x"].count("t" * 3500) == 1 and "t" * 3501 not in user["x"] and "- f1\n- f2" in user["p"] and "3 missing" in user["p"]
    assert "(none)" in user["a"] and user["j"].index("one") < user["j"].index("two") and "aesthetic: calm" in user["b"] and "coat" in user["r"] and "work" in user["r"]
    assert row.select(prompts.look_descriptor(F.lit("A"), F.lit(""), F.lit("c"))).first()[0] == "A c"


def test_training_stops_early_and_heads_are_saved(spark, tmp_path):
    rng = np.random.default_rng(3)
    w = rng.normal(size=6)
    pairs = []
    for _ in range(240):
        a, b = rng.normal(size=6), rng.normal(size=6)
        a, b = (a, b) if a @ w > b @ w else (b, a)
        pairs.append((a.tolist(), b.tolist()))
    df = spark.createDataFrame(pairs, "winner array<double>, loser array<double>").repartition(2)
    part = df.withColumn("v", F.rand(1) < 0.25)
    head, told = training.train_preference_head(part.filter("NOT v"), part.filter("v"), hidden=16, epochs=25, rate=0.05, patience=4)
    assert told["valid_accuracy"] > 0.85 and told["epochs"] <= 25
    with pytest.raises(ValueError):
        training.train_preference_head(df.limit(0), df)
    sinks.write_head(spark, str(tmp_path / "head"), **head)
    back = sinks.read_head(spark, str(tmp_path / "head"))
    assert all(np.allclose(back[k], v) for k, v in head.items())
    with pytest.raises(FileNotFoundError):
        sinks.read_head(spark, str(tmp_path / "none"))
    stop = training.EarlyStop(2)
    assert [stop.add(x, {}) for x in (1.0, 2.0, 2.0, 1.5)] == [False, False, False, True] and stop.best == 2.0


def test_gradients_against_differences():
    rng = np.random.default_rng(5)
    x, w = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
    weights = rng.random((5, 5))
    weights[4] = 0
    g, loss = training.contrastive_step(x, weights, w, 0.5)
    for i in range(3):
        for j in range(3):
            off = np.zeros((3, 3))
            off[i, j] = 1e-6
            up, down = (training.contrastive_step(x, weights, w + s * off, 0.5)[1] for s in (1, -1))
            assert abs((up - down) / 2e-6 - g[i, j]) < 1e-5


def test_projection_brings_labels_together(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "ab"[i % 2], (np.array([0.3 * (i % 2), 0, 0]) + rng.normal(size=3) * [0.05, 1, 1]).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, label string, v array<double>")
    weights = supervision.weights(df.select(F.col("label").alias("owner"), F.lit("").alias("concept")).distinct(), "labels")
    z, labels = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])

    def top1(w):
        u = z @ w.T
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        s = u @ u.T
        np.fill_diagonal(s, -2)
        return float((labels[s.argmax(1)] == labels).mean())

    w, best = training.train_projection(df, weights, top1, "id", "label", "v", epochs=30, rate=0.1, patience=12)
    assert best >= top1(np.eye(3)) and abs(top1(w) - best) < 1e-9
    targets = training.concept_targets(spark.createDataFrame([("x", "wool"), ("y", "silk")], "owner string, concept string"), spark.createDataFrame([("wool",), ("silk",)], "concept string"))
    assert {r["owner"]: r["target"] for r in targets.collect()} == {"x": [0, 1], "y": [1, 0]}


def test_reports_need_rows_and_splits_share_no_group(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], f"g{i % 8}", [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(40)], "id int, label string, g string, v array<double>")
    told = vectors.accuracy_report(rows, F.col("id") < 10, "id", "label", "v", iterations=20).first()
    assert (told["top1"], told["n_test"], told["n_labels"], told["random_top1"], told["lo"]) == (1.0, 10, 2, 0.5, 1.0)
    with pytest.raises(ValueError):
        vectors.accuracy_report(rows.limit(4), F.col("id") < 2, "id", "label", "v")
    parts = evaluation.three_way(rows, F.col("g")).groupBy("g").agg(F.countDistinct("part").alias("n"), F.first("part").alias("p")).collect()
    assert all(r["n"] == 1 for r in parts) and {r["p"] for r in parts} == {"train", "valid", "test"}
    keys = spark.range(500).select(F.col("id").cast("string").alias("key"))
    assert {r["key"] for r in evaluation.first_in_order(keys, 77).collect()} == {r["key"] for r in keys.orderBy(evaluation.hash_order(F.col("key")), "key").limit(77).collect()}


def test_a_stack_does_without_what_is_missing(spark):
    class Grid:
        def segment(self, image):
            return [["Dress"] * 4] * 4 if image == b"dress" else 1 / 0

    def fails(_):
        raise OSError("no weights")

    stack = perception.build_stack({"segmenter": ((), lambda _: Grid()), "embedder": ((), fails), "index": (("embedder",), lambda _: 1)})
    assert stack.embedder is None and stack.index is None and len(stack.notes) == 2 and stack.nothing is None
    assert capabilities.see(spark, stack, b"dress").garments == ["Dress"] and capabilities.see(spark, stack, b"other").garments == []
    index = spark.createDataFrame([(0, [1.0, 0.0], {"title": "coat"}), (1, [0.0, 1.0], {"label": "hat"})], "row long, embedding array<double>, meta map<string,string>")
    near = spark.createDataFrame([("cubism", [1.0, 0.0])], "label string, centroid array<double>")
    head = {"w1": np.eye(2), "b1": np.zeros(2), "w2": np.zeros(2), "b2": np.zeros(1)}
    full = perception.Stack({"embedder": lambda image: [1.0, 0.0], "index": index, "head": head, "movements": near, "runway": 5})
    seen = capabilities.see(spark, full, b"x", 1)
    assert (seen.similar, seen.score, seen.movements, seen.lineage) == (["coat"], 50, ["cubism"], []) and "runway failed" in seen.notes[0]
    review = capabilities.standard(models.EchoModel({"Garments: Dress": "nice"}), capabilities.Knowledge(), stack)["style"]
    assert review.run(spark, {"image": b"dress", "occasion": "gala"}).text == "nice"
    with pytest.raises(FileNotFoundError):
        review.run(spark, "")


def test_stores_and_sources(spark, tmp_path):
    assert sinks.open_triples(spark, str(tmp_path / "none")).count() == 0
    notes = spark.createDataFrame([("capes", "fall", 2026, "runways"), ("capes", "fall", 2026, "runways")], "element string, season string, year int, context string")
    for _ in range(2):
        sinks.add_annotations(notes, str(tmp_path / "chunks"), retrieval.hashing_encoder(4))
    assert sinks.read_rows(spark, str(tmp_path / "chunks")).count() == 1
    with pytest.raises(KeyError):
        files.load_pairs(spark, str(tmp_path), ["nope"])
    (tmp_path / "surrey").mkdir()
    for name in ("a.jpg", "b.jpg"):
        (tmp_path / "surrey" / name).write_bytes(b"x")
    (tmp_path / "surrey" / "aesthetic_1.txt").write_text("a.jpg b.jpg 2\na.jpg gone.jpg 1\nnonsense\n")
    items, pairs = files.load_pairs(spark, str(tmp_path), ["surrey"])
    assert items.count() == 2 and [tuple(r) for r in pairs.collect()] == [("surrey:b.jpg", "surrey:a.jpg")]
    catalogue = tmp_path / "catalogue"
    catalogue.mkdir()
    (catalogue / "a.csv").write_text("productDisplayName,season\nBlue dress,Summer\n")
    (catalogue / "b.csv").write_text("season,name\nWinter,Red coat\n")
    assert sorted(r["text"] for r in files.fashion_products(spark, str(catalogue)).collect()) == ["Blue dress. season: Summer", "Red coat. season: Winter"]
    spark.createDataFrame([([1.0], "hat", None), ([0.5], None, {"title": "t"})], "embedding array<double>, label string, metadata map<string,string>").write.parquet(str(tmp_path / "index"))
    assert sorted(map(str, (r["meta"] for r in files.visual_index(spark, str(tmp_path / "index")).collect()))) == ["{'label': 'hat', 'source': 'fashionpedia'}", "{'title': 't'}"]
    pages = spark.createDataFrame([("a", 0, "x" * 200), ("b", 0, None), ("b", 9, "y" * 500)], "path string, page int, text string")
    assert [r["path"] for r in files.needs_ocr(pages).collect()] == ["b"]
