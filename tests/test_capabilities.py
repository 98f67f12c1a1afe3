import json

import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.operators import capabilities as C
from tessera.operators import retrieval
from tessera.operators import triples as T
from tessera.operators.models import EchoModel

TEXTS = ["Wool is a warm fibre that keeps its shape in the cold, and it takes dye well. " * 3, "Silk drapes like water and shines; it suits summer evenings and formal dress. " * 3]


def store(spark):
    docs = spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(TEXTS)], "ord long, text string, source string")
    return retrieval.build_store(docs, retrieval.hashing_encoder())


def test_retrieval(spark):
    asked = spark.createDataFrame([(1, "warm wool in the cold"), (2, "silk for summer")], "id long, query string")
    hits = retrieval.retrieve(store(spark), asked, retrieval.hashing_encoder(), n=1).collect()
    assert {r["query_id"]: r["source"] for r in hits} == {1: "s0", 2: "s1"}
    only = retrieval.retrieve(store(spark), asked, retrieval.hashing_encoder(), 3, where=F.col("source") == "s1").collect()
    assert {r["source"] for r in only} == {"s1"} and all(r["distance"] >= 0 for r in only)
    assert retrieval.retrieve(store(spark).limit(0), asked, retrieval.hashing_encoder()).count() == 0


def test_routing_and_grounding(spark):
    t = T.canonical_triples(spark.createDataFrame([(0, "Prada", "based_in", "Milan", "", "", "t")], "ord long, subject string, relation string, object string, subject_type string, object_type string, source string"))
    seen = []

    class Recorder(EchoModel):
        def complete(self, prompt, system="", max_tokens=512):
            seen.append((prompt, system))
            return "done"

    known = C.Knowledge(store(spark), t)
    caps = C.standard(Recorder(), known)
    intent, result = C.route(spark, caps, "trend forecast for wool at Prada", depth="surface", form="chat")
    assert intent == "analyze" and result.text == "done" and result.sources == ["s0", "s1"]
    assert "- Prada based in Milan" in seen[0][0] and "Retrieved passages:" in seen[0][0] and seen[0][1].startswith("Be concise")
    caps["bootstrap"].run(spark, {"aesthetic": "quiet wool", "audience": "all"})
    assert "aesthetic: quiet wool" in seen[1][0] and "audience: all" in seen[1][0]
    assert C.Grounded(Recorder(), C.Knowledge(), "x").run(spark, "y").sources == []
    with pytest.raises(LookupError):
        C.route(spark, caps, "the weather is nice")


def test_command_line(spark, tmp_path):
    root = tmp_path / "raw/wikipedia"
    root.mkdir(parents=True)
    for n, t in enumerate(TEXTS):
        (root / f"page-{n}.txt").write_text(t)
    at = ["--root", str(tmp_path)]
    assert cli.main([*at, "data", "build", "--source", "wikipedia"]) == ["wikipedia: raw 2, kept 2, chunks 2"]
    assert "Wool" in cli.main([*at, "data", "smoke", "warm wool", "-n", "1"])[0]
    (tmp_path / "t.json").write_text("\n".join(json.dumps({"ord": i, "subject": s, "relation": r, "object": o}) for i, (s, r, o) in enumerate([("Prada", "located in", "Milan"), ("Miu Miu", "part_of", "Prada")])))
    assert cli.main([*at, "kg", "add", str(tmp_path / "t.json")]) == ["added 2"]
    assert cli.main([*at, "kg", "add", str(tmp_path / "t.json")]) == ["added 0"]
    assert cli.main([*at, "kg", "query", "prada"]) == ["Prada based in Milan", "Miu Miu part of Prada"]
    assert cli.main([*at, "kg", "path", "Miu Miu", "Milan"]) == ["Miu Miu —part_of→ Prada —based_in→ Milan"]
    assert cli.main([*at, "kg", "who", "based_in", "Milan"]) == ["Prada"]
    assert "triples: 2" in cli.main([*at, "kg", "stats"])
    assert cli.main([*at, "route", "start a brand from scratch"])[:2] == ["bootstrap", ""]  # the echoing model has nothing to say
    assert cli.main([*at, "route", "the weather is nice"]) == ["unknown"]
    (tmp_path / "f.json").write_text(json.dumps({"fabric": "loden", "weight": "heavy", "drape": "", "warmth": "warm", "season": ["winter"], "texture": ["felted"], "properties": ["dense"]}))
    assert cli.main([*at, "kg", "add-fabrics", str(tmp_path / "f.json")]) == ["added 5"]
    assert cli.main([*at, "kg", "add-fabrics", str(tmp_path / "f.json")]) == ["added 0"]
    assert "judge_tie: 2" in cli.main([*at, "kg", "eval", "-n", "2"])
    assert len(cli.main(["data", "list"])) == 3 and cli.main(["info"])


def test_vision_commands(spark, tmp_path):
    (tmp_path / "eye_for_tests.py").write_text("def embed(image):\n    return [1.0, 0.0] if image[0] == 97 else [0.0, 1.0]\n\n\ndef tell(image, prompt, system):\n    return '{\"caption\": \"a look\", \"materials\": [\"wool felt\"]}'\n")
    shows = tmp_path / "raw/runway"
    for house, first in (("Marni", b"a"), ("Prada", b"zz")):
        for n in range(6):
            folder = shows / house / f"show{n % 3}"
            folder.mkdir(parents=True, exist_ok=True)
            (folder / f"{n}.json").write_text(json.dumps({"designer": house, "show": f"show{n % 3}", "season": "Fall 2026"}))
            (folder / f"{n}.png").write_bytes(first * (3 if house == "Marni" else 30) + str(n).encode())
    swatches = tmp_path / "raw/textures/Wool"
    swatches.mkdir(parents=True)
    (swatches / "1.png").write_bytes(b"abc")
    at = ["--root", str(tmp_path), "vision"]
    spark.sparkContext.addPyFile(str(tmp_path / "eye_for_tests.py"))
    assert cli.main([*at, "build-runway", "--eye", "eye_for_tests:embed"]) == ["looks: 12, houses: 2"]
    assert "top1: 1.0" in cli.main([*at, "eval-runway"])
    assert cli.main([*at, "build-textures", "--eye", "eye_for_tests:embed"]) == ["fabrics: 1"]
    assert cli.main([*at, "extract-runway", "--eye", "eye_for_tests:tell", "--per-collection", "1"]) == ["Marni: looks 3, captions 3, triples 2", "Prada: looks 3, captions 3, triples 2"]
    assert cli.main([*at, "extract-runway", "--eye", "eye_for_tests:tell", "--per-collection", "1"]) == ["nothing left"]
    assert "runway: there" in cli.main(at)
    with pytest.raises(SystemExit):
        cli.main([*at, "build"])
