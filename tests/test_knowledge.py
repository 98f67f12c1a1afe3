import pytest
from pyspark.sql import functions as F

from tessera.functions import naming, phrases
from tessera.operators import context, graph, perception, supervision
from tessera.operators import triples as T

RAW = "ord long, subject string, relation string, object string, subject_type string, object_type string, source string"


def store(spark, *facts):
    return T.canonical_triples(spark.createDataFrame([(i, s, r, o, "", "", "t") for i, (s, r, o) in enumerate(facts)], RAW))


def texts(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_names(spark):
    names = {"  Maison   Margiela ": "maison margiela", "Céline": "celine", "Christian Dior Couture": "dior", "Dior Homme": "dior", "Christian Dior SE": "dior", "Dior Parfums": "dior", "christian_dior": "dior", "YSL": "saint laurent", "Yves Saint Laurent": "saint laurent", "House": "house", "The Row": "the row"}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", naming.canonical_entity(F.col("n")).alias("k")).collect()
    assert {r["n"]: r["k"] for r in got} == names
    doubtful = {"ne": False, "john galliano from givenchy dior and his eponymous line": False, "1950s christian dior silhouettes": False, "Maison Margiela": True, "1990s": True, "Fall 2026": True, "a b c d e f g": False, "": False}
    got = spark.createDataFrame([(n,) for n in doubtful], "n string").select("n", naming.is_plausible(naming.normalize_entity(F.col("n"))).alias("p")).collect()
    assert {r["n"]: r["p"] for r in got} == doubtful


def test_store(spark):
    t = store(spark, ("Prada", "located in", "Milan"), ("Prada", "creative_director", "Miuccia Prada"), ("Miu Miu", "belongs-to", "Prada"), ("Prada", "loves", "Milan"), ("Prada", "part_of", "prada"), ("", "based_in", "Milan"), ("PRADA", "based_in", "milan"))
    assert texts(t, "subject", "relation", "object") == [("Miu Miu", "part_of", "Prada"), ("Prada", "based_in", "Milan"), ("Prada", "creative_director", "Miuccia Prada")]
    assert T.insert_new(t, t).count() == 0
    assert texts(T.facts(t, "prada"), "fact") == [("Miu Miu part of Prada",), ("Prada based in Milan",), ("Prada creative director Miuccia Prada",)]
    assert dict(texts(T.stats(t), "item", "n"))["triples"] == 3
    assert texts(T.subjects_with(t, "from", "MILAN"), "subject") == [("Prada",)]


def test_reasoning(spark):
    t = store(spark, ("Prada", "based_in", "Milan"), ("Miu Miu", "part_of", "Prada"), ("Miuccia Prada", "creative_director", "Prada"), ("Raf Simons", "collaborated_with", "Miuccia Prada"), ("Jil Sander", "based_in", "Milan"), ("Raf Simons", "creative_director", "Jil Sander"))
    got = graph.shortest_paths(t, "Raf Simons", "Prada").select(phrases.path_text(F.col("start"), F.col("path")).alias("p"), "hops").collect()
    assert [tuple(r) for r in got] == [("Raf Simons —collaborated_with→ Miuccia Prada —creative_director→ Prada", 2)]
    assert graph.shortest_paths(t, "Miu Miu", "Nowhere").count() == 0
    assert graph.shortest_paths(t, "Prada", "PRADA").count() == 0
    first = graph.shortest_paths(t, "Miu Miu", "Milan").select(phrases.path_text(F.col("start"), F.col("path")).alias("p")).first()["p"]
    assert first.startswith("Miu Miu —")
    assert ("Milan",) in texts(graph.two_hop(t, "Miu Miu"), "object")
    assert dict(texts(graph.hop_distances(t, "Miu Miu", 3), "node", "hops")) == {"miu miu": 0, "prada": 1, "milan": 2, "miuccia prada": 2, "jil sander": 3, "raf simons": 3}


def test_link_candidates(spark):
    known = store(spark, ("Jil Sander", "based_in", "Hamburg"), ("Jil Sander", "known_for", "minimalism"))
    raw = '[{"subject":"Jil Sander","relation":"known_for","object":"minimalism"},{"subject":"Jil Sander","relation":"influenced_by","object":"Bauhaus"},{"subject":"Prada","relation":"based_in","object":"Milan"}]'
    rows = spark.createDataFrame([(0, raw, "llm_predicted"), (1, "no json", "llm_predicted")], "ord long, raw string, source string")
    fresh = T.new_candidates(T.canonical_triples(perception.parse_triples(rows, "raw", "source")), known).filter("subject_key = 'jil sander'")
    assert texts(fresh, "object", "source") == [("Bauhaus", "llm_predicted")]


def test_descriptors_and_fabrics(spark):
    t = store(spark, ("Dior", "known_for", "New Look"), ("Dior", "based_in", "Paris"), ("Dior", "uses_material", "silk"), ("Dior", "uses_material", "wool"), ("Acne", "based_in", "Stockholm"))
    assert texts(T.descriptors(t), "descriptor") == [("Dior — New Look; silk, wool; Paris",)]
    fabrics = spark.createDataFrame([("silk", "light", "fluid", "", ["summer"], ["smooth"], None)], "fabric string, weight string, drape string, warmth string, season array<string>, texture array<string>, properties array<string>")
    assert texts(T.canonical_triples(T.fabric_triples(fabrics)), "relation", "object") == [("has_property", "fluid drape"), ("has_property", "light weight"), ("has_texture", "smooth"), ("suits_season", "summer")]


def test_repeated_fabrics_and_looks_are_few_rows_before_they_are_keyed(spark):
    fabrics = spark.range(300).selectExpr("concat('cloth ', id % 3) AS fabric", "'light' AS weight", "'' AS drape", "'warm' AS warmth", "array('summer') AS season", "array('soft') AS texture", "array('woven') AS properties")
    assert T.fabric_triples(fabrics).count() == 3 * 5
    looks = spark.range(300).selectExpr("id AS ord", "concat('house ', id % 3) AS designer", "'Fall' AS season", "named_struct('silhouettes', array('slim'), 'materials', array('wool', 'felt'), 'aesthetics', array('calm')) AS look")
    told = perception.look_triples(looks)
    assert told.count() == 3 * 5 and told.agg(F.max("ord")).first()[0] == 204
    assert T.canonical_triples(told).count() == 15


def test_context(spark):
    t = store(spark, ("Prada", "based_in", "Milan"), ("Miu Miu", "part_of", "Prada"))
    queries = spark.createDataFrame([(1, "Tell me about PRADA in Milan"), (2, "something unrelated"), (3, None)], "id int, q string")
    matched = context.matched_entities(queries, T.entities(t), "id", "q")
    assert texts(matched, "id", "entity", "place") == [(1, "milan", 1), (1, "prada", 2)] or texts(matched, "id", "entity") == [(1, "milan"), (1, "prada")]
    assert texts(context.entity_facts(matched, t), "id", "fact") == [(1, "Miu Miu part of Prada"), (1, "Prada based in Milan")]
    said = spark.createDataFrame([("I want to start a brand from scratch", ""), ("what should i wear tonight", ""), ("show me the trend forecast", ""), ("the weather is nice", ""), ("qwerty", "I say: design")], "q string, reply string")
    assert [r["intent"] for r in context.classify(said, "q", reply_col="reply").collect()] == ["bootstrap", "style", "analyze", "unknown", "design"]
    line = spark.createDataFrame([("Wool", "web", " Wool is\nwarm. "), ("", "web", "x"), (None, None, "y")], "title string, source string, d string").select(phrases.passage_line(F.col("title"), F.col("source"), F.col("d")).alias("l"))
    assert [r["l"] for r in line.collect()] == ["- [Wool] Wool is warm.", "- [web] x", "- [source] y"]
    block = spark.createDataFrame([(["a", "b"], "- p"), ([], "- p"), (["a"], "")], "f array<string>, p string").select(phrases.knowledge_block(F.col("f"), F.col("p")).alias("b"))
    assert [r["b"] for r in block.collect()] == ["Knowledge-graph facts:\n- a\n- b\n\nRetrieved passages:\n- p", "Retrieved passages:\n- p", "Knowledge-graph facts:\n- a"]
    with pytest.raises(ValueError):
        phrases.directive("deep")
    assert phrases.directive().startswith("Be thorough")


def test_verdicts_and_coverage(spark):
    raw = ["A", "TIE", "", None, "x\nVERDICT: A", "Answer A is vague; B wins.\nVERDICT: B", "VERDICT: TIE", "equal", "VERDICT: ?", "Both"]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string").select("i", phrases.verdict(F.col("r")).alias("v")).orderBy("i").collect()
    assert [r["v"] for r in got] == ["A", "tie", "tie", "tie", "A", "B", "tie", "tie", "tie", "B"]
    rows = spark.createDataFrame([("Paris and silk", ["paris", "SILK"]), ("Paris", ["paris", "wool"]), ("x", []), ("x", ["", "x"])], "a string, g array<string>").select(phrases.coverage(F.col("a"), F.col("g")).alias("c"))
    assert [r["c"] for r in rows.collect()] == [1.0, 0.5, 0.0, 0.5]


def test_supervision(spark):
    t = store(spark, ("Jil Sander", "known_for", "minimalist"), ("Jil Sander", "uses_material", "Wool_felt"), ("Jil Sander", "based_in", "Milan"), ("The Row", "known_for", "Minimalist"), ("The Row", "has_silhouette", "draped"), ("The Row", "from_era", "2026"))
    owned = supervision.concepts(t)
    assert texts(owned, "owner", "concept") == [("jil sander", "minimalist"), ("jil sander", "wool felt"), ("the row", "draped"), ("the row", "minimalist")]
    assert texts(supervision.concept_vocabulary(owned), "concept") == [("minimalist",)]
    assert texts(supervision.jaccard_pairs(owned), "a", "b", "jaccard") == [("jil sander", "the row", 1 / 3)]
    assert len(texts(supervision.weights(owned), "a", "b", "weight")) == 4
    with pytest.raises(ValueError):
        supervision.weights(owned, "other")
    looks = spark.createDataFrame([(0, "jil sander", "s1"), (1, "jil sander", "s2"), (2, "the row", "s1"), (3, "nobody", "s1")], "row long, designer string, show string")
    report = supervision.signal_report(looks, owned).first()
    assert (report["n_images"], report["n_designers"], report["n_collections"], report["images_without_concepts"], report["unique_concepts"], report["shared_concepts"], report["shared_fraction"], report["mean_jaccard"]) == (4, 3, 4, 1, 3, 1, 0.333, 0.111)
    qa = supervision.question_answers(store(spark, ("Celine", "founded_by", "Céline Vipiana"), ("Celine", "based_in", "1978"), ("Celine", "uses_material", "leather"), ("Celine", "uses_material", "silk"), ("Celine", "uses_material", "wool")))
    assert texts(qa, "question", "answer") == [("What materials is Celine known for using?", "Celine frequently works with leather, silk, and wool."), ("Who founded Celine?", "Celine was founded by Céline Vipiana.")]
    scored = spark.createDataFrame([("a", 8.0), ("b", 3.0), ("c", 5.0)], "id string, score double")
    assert texts(supervision.margin_pairs(scored, 1.0, 10), "winner", "loser") == [("a", "b"), ("a", "c"), ("c", "b")]
    assert supervision.margin_pairs(scored, 9.0, 10).count() == 0
    fifty = spark.range(50).select(F.col("id").cast("string").alias("id"), F.col("id").cast("double").alias("score"))
    assert supervision.margin_pairs(fifty, 1.0, 10).count() == 10
    seeds = spark.createDataFrame([("in", "ctx", "out"), ("in", "nan", "out"), ("", "c", "out"), ("in", None, "")], "input string, context string, completion string")
    assert texts(supervision.seed_examples(seeds), "user") == [("in",), ("in\n\nOccasion/context: ctx",)]


def test_products(spark):
    rows = spark.createDataFrame([("Nike Court Sneakers", "Men", "White"), ("", None, None), (None, "Men", "nan"), ("Bag", "", None)], "name string, gender string, baseColour string")
    got = rows.select(phrases.describe_product(F.col("name"), {c: F.col(c) for c in ("gender", "baseColour")}).alias("d")).collect()
    assert [r["d"] for r in got] == ["Nike Court Sneakers. gender: Men; baseColour: White", "", "Fashion product. gender: Men", "Bag"]


def test_star_facts_are_told_once_and_as_the_sql_has_them(spark):
    """Parts share names: what they repeat is combined before it is keyed, and the triples stay the same."""
    import duckdb

    from tessera.plans import catalog

    at = "/root/testdata/sf0.001"
    facts = [c for c in catalog.raw_triples(spark, at).columns if c != "ord"]
    raw = catalog.raw_triples(spark, at).select(*facts)
    assert raw.count() == raw.distinct().count()
    con = duckdb.connect()
    for n in catalog.STAR:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{at}/{n}.parquet'")
    wanted = con.execute(f"WITH {catalog.KG} SELECT ord, subject, relation, object, subject_key, object_key FROM triples").fetchall()
    assert sorted(map(tuple, catalog.kg_build_triples(spark, at).collect())) == sorted(wanted)
