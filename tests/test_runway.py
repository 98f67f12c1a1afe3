"""Pictures: embedding, resumable captioning, recognition; stored index files; settings and models by name."""

import http.server
import json
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import settings
from tessera.operators import runway
from tessera.sources import files, sinks
from tessera.sources.storage import shared_path


def test_embedded_leaves_out_what_fails(spark):
    def embed(content):
        if content == b"bad":
            raise ValueError("no picture")
        return [float(len(content)), 1.0]

    rows = spark.createDataFrame([(1, bytearray(b"abc")), (2, bytearray(b"bad")), (3, None)], "look int, image binary")
    assert [tuple(r) for r in runway.embedded(rows, embed).collect()] == [(1, [3.0, 1.0])]
    assert runway.embedded(rows.limit(0), embed).collect() == []


def describer(fails=()):
    """Sent to the workers as it is, not by the name of this module."""

    def describe(image, prompt, system):
        name = image.decode()
        if name in fails:
            raise OSError("down")
        assert "JSON" in system and "Designer: Marni" in prompt
        return '{"caption": "look %s", "materials": ["wool felt", "fibre %s"]}' % (name, name) if name != "c" else "no idea"

    return describe


def test_extraction_goes_on_where_it_broke_off(spark):
    at = shared_path(spark, "runway")
    rows = [(n, "Marni", "Fall", "Fall 2026", bytearray(n.encode())) for n in "abcdef"] + [("g", "Marni", "Spring", "", bytearray(b"g"))]
    looks = spark.createDataFrame(rows, "look string, designer string, show string, season string, image binary")
    run = lambda fails=(), **o: [tuple(r) for r in runway.extract(looks, describer(fails), f"{at}/c", f"{at}/t", **o).collect()]
    assert run(("b",), per_collection=4) == [("Marni", 4, 3, 5)]  # a, c, d and g of a to d and g: wool felt, three fibres, the era
    assert run(per_collection=4) == [("Marni", 2, 1, 1)]  # b, which failed, and c, which has no caption
    assert run(per_collection=4) == [("Marni", 1, 0, 0)]
    assert run(per_collection=None, limit=2) == [("Marni", 2, 1, 1)]
    stored = sinks.stored_json(spark, f"{at}/c", runway.CAPTIONS)
    assert sorted(r["look"] for r in stored.collect()) == ["a", "b", "d", "e", "g"]
    assert sinks.open_triples(spark, f"{at}/t").count() == 7


def test_recognition_of_separable_houses(spark):
    rng = np.random.default_rng(1)
    rows = [(f"{i}", f"h{i % 4}", f"s{i % 12}", (np.eye(4)[i % 4] + 0.1 * rng.normal(size=4)).tolist()) for i in range(240)]
    report = runway.recognition(spark.createDataFrame(rows, "look string, designer string, show string, embedding array<double>"), iterations=200).first()
    assert report["top1"] == 1.0 and report["split_by"] == "group" and report["lo"] == report["hi"] == 1.0


def test_packed_index_files(spark, tmp_path):
    np.savez(tmp_path / "b.npz", embeddings=np.array([[1, 2], [3, 4]], dtype=np.float32), metadata=np.array(json.dumps([{"title": "x", "year": 2020}, {"title": None}])))
    np.savez(tmp_path / "a.npz", embeddings=np.array([[5.0, 6.0]]))
    got = [(r["embedding"], r["meta"]) for r in files.packed_index(spark, str(tmp_path)).orderBy("row").collect()]
    assert got == [([5.0, 6.0], {}), ([1.0, 2.0], {"title": "x", "year": "2020"}), ([3.0, 4.0], {})]
    with pytest.raises(FileNotFoundError):
        files.packed_index(spark, str(tmp_path / "none"))


def test_settings_and_models_by_name():
    s = settings.Settings.from_env({"TESSERA_TOP_K": "8", "TESSERA_BACKEND": "http", "TESSERA_MODEL": "m", "OTHER": "1"})
    assert (s.top_k, s.chunk_size, s.backend) == (8, 512, "http")
    with pytest.raises(ValueError, match="TESSERA_TOP_K"):
        settings.Settings.from_env({"TESSERA_TOP_K": "many"})
    with pytest.raises(ValueError, match="unknown back end"):
        settings.model_of(settings.Settings(backend="abacus"))
    with pytest.raises(ValueError, match="MODEL"):
        settings.model_of(settings.Settings(backend="http"))
    assert settings.model_of(settings.Settings()).complete("x") == ""


def test_chat_endpoint_against_a_local_server(spark):
    from tessera.operators import models

    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers.get("Authorization"), body))
            reply = json.dumps({"choices": [{"message": {"content": body["messages"][-1]["content"].upper()}}]}).encode()
            self.send_response(500 if "boom" in body["messages"][-1]["content"] else 200)
            self.end_headers()
            self.wfile.write(reply)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        model = settings.model_of(settings.Settings(backend="http", model="m", endpoint=f"http://127.0.0.1:{server.server_port}/v1", api_key="k"))
        rows = spark.createDataFrame([(1, "hi"), (2, "boom")], "id int, p string")
        got = {r["id"]: r["reply"] for r in models.completed(rows, "p", model, system="be kind").select("id", F.col("reply")).collect()}
        assert got == {1: "HI", 2: ""}
        path, key, body = next(x for x in seen if x[2]["messages"][-1]["content"] == "hi")
        assert (path, key, body["model"], body["messages"][0]) == ("/v1/chat/completions", "Bearer k", "m", {"role": "system", "content": "be kind"})
    finally:
        server.shutdown()
