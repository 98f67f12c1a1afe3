import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import perception, trends
from tessera.operators import triples as T
from tessera.sources import files, sinks
from tessera.streaming import ingest as streams

PNG = b"\x89PNG"


def test_products(spark, tmp_path):
    root = tmp_path / "p"
    (root / "deep").mkdir(parents=True)
    pd.DataFrame({"productDisplayName": ["Nike Court Sneakers", None], "gender": ["Men", None], "baseColour": ["White", None], "year": [2024, None], "usage": ["Casual", None]}).to_parquet(root / "deep/a.parquet")
    (root / "b.csv").write_text('name,season\n"Bag, big",Summer\n,nan\n')
    got = {r["text"]: r["metadata"] for r in files.fashion_products(spark, str(root)).collect()}
    nike = next(k for k in got if k.startswith("Nike Court Sneakers."))
    assert "baseColour: White" in nike and "usage: Casual" in nike and "Bag, big. season: Summer" in got and len(got) == 2
    assert got[nike]["colour"] == "White" and got[nike]["source"] == "fashion_products"
    with pytest.raises(FileNotFoundError):
        files.fashion_products(spark, str(tmp_path / "none"))
    with pytest.raises(KeyError):
        files.source("nope")
    assert files.source("wikipedia")[1] is files.text_files


def test_texts_and_instructions(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/coco-chanel.txt").write_bytes("Gabrielle\nChanel é".encode() + b"\xff")
    row = files.text_files(spark, str(tmp_path / "t")).first()
    assert row["text"] == "Gabrielle\nChanel é" and row["metadata"]["title"] == "coco chanel" and row["metadata"]["source"] == "wikipedia"
    (tmp_path / "i").mkdir()
    lines = [{"input": "tall", "context": "gala", "completion": "wear silk"}, {"input": "x", "response": "other"}, {"input": "x", "completion": " "}]
    (tmp_path / "i/a.jsonl").write_text("\n\n".join(map(json.dumps, lines)))
    pd.DataFrame([{"input": "short", "context": "", "completion": "boots"}]).to_parquet(tmp_path / "i/b.parquet")
    got = sorted(r["text"] for r in files.style_instructions(spark, str(tmp_path / "i")).collect())
    assert got == ["Styling example. Profile: short. Occasion: . Advice: boots", "Styling example. Profile: tall. Occasion: gala. Advice: wear silk", "Styling example. Profile: x. Occasion: . Advice: other"]


def test_annotations(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('element,category,season,year,trend_score,context\nboots,shoes,FW,2023,0.5,"a, b"\ncape,coat,FW,2024,0.7,c\nboots,shoes,SS,2024,0.9,d\nboots,shoes,FW,2024,0.4,e\n')
    a = files.trend_annotations(spark, str(p))
    assert {(r["year"], r["element"]): r["score"] for r in trends.snapshots(a).collect()} == {(2023, "boots"): 0.5, (2023, "cape"): 0.0, (2024, "boots"): 0.4, (2024, "cape"): 0.7}
    assert [r["scores"] for r in trends.snapshot_vectors(a).orderBy("year").collect()] == [[0.5, 0.0], [0.4, 0.7]]
    (tmp_path / "bad.csv").write_text("element,year\na,1\n")
    with pytest.raises(ValueError):
        files.trend_annotations(spark, str(tmp_path / "bad.csv"))
    with pytest.raises(FileNotFoundError):
        files.garment_annotations(spark, str(tmp_path))
    (tmp_path / "train_annotations.csv").write_text('image_path,category,attributes\na.jpg,dress,"long, red"\n')
    assert files.garment_annotations(spark, str(tmp_path)).first()["text"] == "dress: long, red"


def test_images(spark, tmp_path):
    (tmp_path / "looks").mkdir()
    for stem, image in (("a", True), ("b", False)):
        (tmp_path / f"looks/{stem}.json").write_text(json.dumps({"designer": "Marni", "show": stem, "season": "FW"}))
        if image:
            (tmp_path / f"looks/{stem}.png").write_bytes(PNG)
    (tmp_path / "looks/c.json").write_text("{broken")
    got = files.runway_looks(spark, str(tmp_path / "looks")).collect()
    assert [(r["title"], bytes(r["image"]), r["type"]) for r in got] == [("Marni — a", PNG, "")]
    (tmp_path / "fabrics/Raw_Silk").mkdir(parents=True)
    (tmp_path / "fabrics/Raw_Silk/1.jpg").write_bytes(PNG)
    (tmp_path / "fabrics/wool.png").write_bytes(PNG)
    assert sorted(r["fabric"] for r in files.fabric_swatches(spark, str(tmp_path / "fabrics")).collect()) == ["raw silk", "wool"]
    products = spark.createDataFrame([("x", (bytearray(PNG),), 2020), ("y", None, 2021)], "productDisplayName string, image struct<bytes: binary>, year int")
    assert [(r["meta"]["title"], r["meta"]["year"]) for r in files.product_images(products).collect()] == [("x", "2020")]


def test_pairs_and_pages(spark, tmp_path):
    p = tmp_path / "aesthetic_1.txt"
    p.write_text("27_6.jpg 28_3.jpg 1\n5_1.jpg 6_2.jpg 2\nbad line\na b 3\n")
    pairs = files.preference_lines(spark, str(p))
    assert sorted(map(tuple, pairs.collect())) == [("27_6.jpg", "28_3.jpg"), ("6_2.jpg", "5_1.jpg")]
    scored = files.scored_images(spark.createDataFrame([("7", bytearray(PNG), 5.5), (None, bytearray(PNG), 3.0)], "image_id string, image binary, mean_score double"))
    assert sorted(r["id"][:4] for r in scored.collect()) == ["7", "ava_"]
    items, pooled = files.pooled_pairs({"s": (spark.createDataFrame([("27_6.jpg",)], "id string"), pairs)})
    assert items.first()["id"] == "s:27_6.jpg" and pooled.count() == 2
    (tmp_path / "c").mkdir()
    (tmp_path / "c/a.txt").write_text("a hyphen-\nated line\n12\n\nend line")
    (tmp_path / "c/b.md").write_text("mark down")
    assert sorted(r["text"] for r in files.corpus_pages(spark, str(tmp_path / "c")).collect()) == ["a hyphenated line end line", "mark down"]
    posts = {"root": {"page": [{"record": {"title": " T ", "x": [{"post_text_content": "word " * 50}]}}, {"record": {"post_text_content": "few"}}]}}
    (tmp_path / "blog.json").write_text(json.dumps(posts))
    got = [r["text"] for r in files.blog_posts(spark, str(tmp_path / "blog.json")).collect()]
    assert got == ["T. " + ("word " * 50).strip()]


def test_sinks(spark, tmp_path):
    raw = spark.createDataFrame([(0, "Prada", "based_in", "Milan", "", "", "t"), (1, "Prada", "based_in", "milan", "", "", "u")], "ord long, subject string, relation string, object string, subject_type string, object_type string, source string")
    t, path = T.canonical_triples(raw), str(tmp_path / "triples")
    assert sinks.append_triples(t, path) == 1 and sinks.append_triples(t, path) == 0
    rows = spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int")
    sinks.upsert_rows(rows, str(tmp_path / "u"))
    sinks.upsert_rows(rows.filter("id = 'b'").withColumn("v", F.lit(2)), str(tmp_path / "u"))
    assert sorted(map(tuple, sinks.read_rows(spark, str(tmp_path / "u")).collect())) == [("a", 1), ("b", 2)]
    memory = sinks.Memory(spark, str(tmp_path / "m"))
    assert memory.recall("brand", "tier", "none") == "none"
    memory.remember("brand", tier="luxury", name="x")
    memory.remember("brand", tier="mass")
    assert memory.snapshot("brand") == {"tier": "mass", "name": "x"}
    sinks.write_vectors(spark.createDataFrame([(1, [3.0, 4.0])], "row long, embedding array<double>"), str(tmp_path / "v"))
    assert [round(x, 6) for x in sinks.read_vectors(spark, str(tmp_path / "v")).first()["embedding"]] == [0.6, 0.8]
    with pytest.raises(FileNotFoundError):
        sinks.read_vectors(spark, str(tmp_path / "w"))


def test_regions_and_looks(spark):
    pixels = spark.createDataFrame([(1, y, x, "Dress" if x < 5 else "Hat" if x < 6 and y == 0 else "Face") for y in range(10) for x in range(10)], "image int, y int, x int, label string")
    assert [(r["label"], r["area"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in perception.regions(pixels).collect()] == [("Dress", 0.5, 0, 0, 5, 10)]
    raw = ['{"caption": "c", "silhouettes": "a-line", "materials": ["x", " ", 3], "palette": null}', "no", None, "{bad json", '{"materials": ["1","2","3","4","5","6","7"]}']
    got = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string").select("i", perception.parse_look(F.col("r")).alias("l")).orderBy("i").collect()
    assert got[0]["l"]["silhouettes"] == ["a-line"] and got[0]["l"]["materials"] == ["x", "3"] and got[0]["l"]["palette"] == []
    assert all(r["l"]["caption"] == "" and r["l"]["garments"] == [] for r in got[1:4]) and len(got[4]["l"]["materials"]) == 6


def test_streams(spark, tmp_path):
    docs = tmp_path / "docs"
    rows = [("2024-01-01 00:00:00", "Same  text"), ("2024-01-01 00:01:00", "same text"), ("2024-01-01 01:30:00", "other")]
    spark.createDataFrame(rows, "ts string, text string").select(F.to_timestamp("ts").alias("ts"), "text").write.parquet(str(docs))
    stream = lambda: spark.readStream.schema("ts timestamp, text string").parquet(str(docs))
    for name, df, mode in (("d", streams.deduplicated(stream(), "ts"), "append"), ("w", streams.windowed_counts(stream(), "ts", "text"), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("d").count() == 2 and spark.table("w").agg(F.sum("n")).first()[0] == 3
    raw = spark.createDataFrame([(i, "Prada", "based_in", "Milan", "", "", "t") for i in range(3)], "ord long, subject string, relation string, object string, subject_type string, object_type string, source string")
    T.canonical_triples(raw).write.parquet(str(tmp_path / "in"))
    for n in range(2):
        source = spark.readStream.schema(T.canonical_triples(raw).schema).parquet(str(tmp_path / "in"))
        streams.append_new_triples(source, str(tmp_path / "out"), str(tmp_path / f"cp{n}")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
