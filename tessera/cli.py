"""Command line: data, knowledge-graph and routing tools over a data root.

    python -m tessera.cli --root DIR data list | data build --source a,b [--limit N] | data smoke QUERY [-n N]
    python -m tessera.cli --root DIR kg add FILE | kg query ENTITY | kg stats | kg path A B | kg who RELATION OBJECT
    python -m tessera.cli --root DIR kg build --source NAME [--limit N] | kg predict ENTITY [-k N] | kg add-fabrics FILE | kg eval [-n N]
    python -m tessera.cli --root DIR bootstrap IDEA | analyze TOPIC | look IMAGE [--occasion O] | route QUERY | info
    python -m tessera.cli --root DIR vision status | vision build | build-runway | build-textures | eval-runway | extract-runway [--per-collection N] [--limit N]

A model is named by --model MODULE:NAME, an object with ``complete(prompt, system)``; without one, the environment's
settings name it (see ``settings``). What looks at pictures is named by --eye MODULE:NAME: for the builds a function of
bytes to a vector, for extract-runway one of (picture, prompt, system) to a reply.
"""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import phrases
from tessera import settings
from tessera.operators import capabilities, context, graph, ingest, knowledge, models, perception, retrieval, runway, vectors
from tessera.operators import triples as T
from tessera.session import session
from tessera.sources import files, sinks
from tessera.sources.storage import exists


def documents(spark: SparkSession, root: str, names: list[str], limit: int | None, *kept: str) -> DataFrame:
    """The named sources' documents with their source (and other metadata) as columns, each cut at ``limit`` before cleaning."""
    out = None
    for name in names:
        folder, read = files.source(name)
        rows = read(spark, f"{root}/raw/{folder}").select(F.monotonically_increasing_id().alias("ord"), "text", *(F.col("metadata")[k].alias(k) for k in ("source", *kept)))
        rows = ingest.first_n(rows, limit) if limit else rows
        out = rows if out is None else out.unionByName(rows)
    return out


def named(name: str) -> object:
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def named_model(name: str | None) -> models.LanguageModel:
    return named(name) if name else settings.model_of(settings.Settings.from_env())


def vision(spark: SparkSession, root: str, action: str, eye: str | None, per_collection: int, limit: int | None) -> list[str]:
    """Index builds over ``raw/``, their check, and the captioning run."""
    if action == "status":
        return [f"{n}: {'there' if part is not None else 'missing'}" for n, part in eyes(spark, root).parts.items()]
    if action == "eval-runway":
        r = runway.recognition(sinks.read_vectors(spark, f"{root}/runway_index").withColumn("look", F.monotonically_increasing_id())).first()
        return [f"{k}: {r[k]}" for k in ("top1", "top3", "top5", "lo", "hi", "n_test", "n_labels", "random_top1")]
    if not eye:
        raise SystemExit(f"vision {action} needs --eye MODULE:NAME")
    seen = named(eye)
    if action == "build":
        tables = files.tabular_files(spark, f"{root}/raw/fashion-products")
        if not tables:
            raise FileNotFoundError(f"no tables under {root}/raw/fashion-products")
        rows = runway.embedded(files.product_images(tables[0].drop("__path"), limit), seen)
        sinks.write_vectors(rows, f"{root}/index")
        return [f"index: {sinks.read_vectors(spark, f'{root}/index').count()}"]
    looks = files.runway_looks(spark, f"{root}/raw/runway") if action != "build-textures" else None
    if action == "build-runway":
        sinks.write_vectors(runway.embedded(looks, seen), f"{root}/runway_index")
        houses = vectors.centroids(sinks.read_vectors(spark, f"{root}/runway_index"), "designer", "embedding")
        houses.write.mode("overwrite").parquet(f"{root}/runway")
        return [f"looks: {sinks.read_vectors(spark, f'{root}/runway_index').count()}, houses: {spark.read.parquet(f'{root}/runway').count()}"]
    if action == "build-textures":
        swatches = runway.embedded(files.fabric_swatches(spark, f"{root}/raw/textures"), seen)
        vectors.centroids(swatches, "fabric", "embedding").write.mode("overwrite").parquet(f"{root}/textures")
        return [f"fabrics: {spark.read.parquet(f'{root}/textures').count()}"]
    told = runway.extract(looks.withColumn("look", F.sha1("image")), seen, f"{root}/captions", f"{root}/triples", per_collection, limit).orderBy("designer").collect()
    return [f"{r['designer']}: looks {r['looks']}, captions {r['captions']}, triples {r['triples_added']}" for r in told] or ["nothing left"]


def eyes(spark: SparkSession, root: str) -> perception.Stack:
    """The parts under ``root``: an index, a scorer's head, prototypes of movements and of runway shows; what is not there is missing."""
    table = lambda name: lambda _: files.visual_index(spark, f"{root}/{name}") if name == "index" else sinks.read_vectors(spark, f"{root}/{name}")
    return perception.build_stack({"index": ((), table("index")), "head": ((), lambda _: sinks.read_head(spark, f"{root}/head")), "movements": ((), table("movements")), "runway": ((), table("runway"))})


def main(argv: list[str] | None = None) -> list[str]:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("--root", default="data")
    p.add_argument("--model")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("info")
    sub.add_parser("route").add_argument("query")
    v = sub.add_parser("vision")
    v.add_argument("action", nargs="?", default="status", choices=("status", "build", "build-runway", "build-textures", "eval-runway", "extract-runway"))
    v.add_argument("--eye")
    v.add_argument("--per-collection", type=int, default=3)
    v.add_argument("--limit", type=int)
    for name in ("bootstrap", "analyze", "look"):
        sub.add_parser(name).add_argument("request")
    sub.choices["look"].add_argument("--occasion", default="")
    data = sub.add_parser("data").add_subparsers(dest="action", required=True)
    data.add_parser("list")
    build = data.add_parser("build")
    build.add_argument("--source", required=True)
    build.add_argument("--limit", type=int)
    smoke = data.add_parser("smoke")
    smoke.add_argument("query")
    smoke.add_argument("-n", type=int, default=5)
    kg = sub.add_parser("kg").add_subparsers(dest="action", required=True)
    kg.add_parser("add").add_argument("file")
    kg.add_parser("add-fabrics").add_argument("file")
    kg.add_parser("eval").add_argument("-n", type=int, default=8)
    kg.add_parser("query").add_argument("entity")
    kg.add_parser("stats")
    made = kg.add_parser("build")
    made.add_argument("--source", required=True)
    made.add_argument("--limit", type=int, default=15)
    made.add_argument("--windows", type=int, default=4, help="windows of each document, 0 for all")
    predict = kg.add_parser("predict")
    predict.add_argument("entity")
    predict.add_argument("-k", type=int, default=5)
    for name, first, second in (("path", "src", "dst"), ("who", "relation", "object")):
        q = kg.add_parser(name)
        q.add_argument(first)
        q.add_argument(second)
    a = p.parse_args(argv)
    spark = session("tessera")
    chunks, triples = f"{a.root}/chunks", f"{a.root}/triples"
    encoder = retrieval.hashing_encoder()
    model = named_model(a.model)
    match a.command, getattr(a, "action", None):
        case "info", _:
            lines = [f"root: {a.root}", f"sources: {', '.join(sorted(files.SOURCES))}", f"chunks: {ingest.CHUNK_SIZE}/{ingest.CHUNK_OVERLAP}"]
        case "route", _:
            intent = context.classify(spark.createDataFrame([(a.query,)], "q string"), "q").first()["intent"]
            store = sinks.read_rows(spark, chunks) if exists(spark, chunks) else None
            able = capabilities.standard(model, capabilities.Knowledge(store, sinks.open_triples(spark, triples), encoder), eyes(spark, a.root))
            lines = [intent]
            if intent in able and intent != "style":  # a look needs its picture
                result = able[intent].run(spark, a.query)
                lines += [result.text, *(f"source: {x}" for x in result.sources)]
        case "vision", action:
            lines = vision(spark, a.root, action, a.eye, a.per_collection, a.limit)
        case ("bootstrap" | "analyze" | "look") as name, _:
            request: object = a.request
            if name == "look":
                request = {"image": spark.read.format("binaryFile").load(a.request).first()["content"], "occasion": a.occasion}
            store = sinks.read_rows(spark, chunks) if exists(spark, chunks) else None
            known = capabilities.Knowledge(store, sinks.open_triples(spark, triples), encoder)
            result = capabilities.standard(model, known, eyes(spark, a.root))[{"look": "style"}.get(name, name)].run(spark, request)
            lines = [result.text, *(f"source: {x}" for x in result.sources)]
        case "data", "list":
            lines = [f"{n}: {folder}" for n, (folder, _) in sorted(files.SOURCES.items())]
        case "data", "build":
            raw = documents(spark, a.root, a.source.split(","), a.limit)
            store = retrieval.build_store(raw, encoder)
            sinks.upsert_rows(store, chunks)
            stats = ingest.run_stats(raw, ingest.clean_documents(raw), store).orderBy("source").collect()
            lines = [f"{r['source']}: raw {r['raw']}, kept {r['kept']}, chunks {r['chunks']}" for r in stats]
        case "data", "smoke":
            hits = retrieval.retrieve(sinks.read_rows(spark, chunks), spark.createDataFrame([(0, a.query)], "id long, query string"), encoder, a.n)
            lines = [f"{r['distance']:.4f} [{r['source']}] {r['document'][:120]}" for r in hits.orderBy("rank").collect()]
        case "kg", "add":
            raw = spark.read.schema("ord long, subject string, relation string, object string, subject_type string, object_type string, source string").json(a.file).fillna("")
            lines = [f"added {sinks.append_triples(T.canonical_triples(raw), triples)}"]
        case "kg", "add-fabrics":
            fabrics = spark.read.schema("fabric string, weight string, drape string, warmth string, season array<string>, texture array<string>, properties array<string>").json(a.file)
            lines = [f"added {knowledge.add_fabrics(fabrics, triples)}"]
        case "kg", "eval":
            store = sinks.read_rows(spark, chunks) if exists(spark, chunks) else None
            told = knowledge.lift_summary(knowledge.answers_of_arms(spark.read.parquet(triples), model, store, encoder, a.n, judge=True)).first()
            lines = [f"{k}: {told[k]}" for k in told.asDict()]
        case "kg", "build":
            docs = documents(spark, a.root, [a.source], None, "title")
            new, per = knowledge.build_graph(docs, model, sinks.open_triples(spark, triples), a.windows or None, a.limit)
            told = per.orderBy("ord").collect()  # a.limit documents
            sinks.append_triples(new, triples)
            lines = [f"{r['title']}: +{r['added']}" for r in told] + [f"docs {len(told)}, triples {sum(r['added'] for r in told)}"]
        case "kg", "predict":
            names = spark.createDataFrame([(0, a.entity)], "ord long, entity string")
            found = knowledge.predict_links(names, sinks.open_triples(spark, triples), model, a.k)
            lines = [r["fact"] for r in found.orderBy("rank").select(phrases.fact_text(F.col("subject"), F.col("relation"), F.col("object")).alias("fact")).collect()]
        case "kg", "query":
            lines = [r["fact"] for r in T.facts(spark.read.parquet(triples), a.entity, 50).collect()]
        case "kg", "stats":
            lines = [f"{r['item']}: {r['n']}" for r in T.stats(spark.read.parquet(triples)).orderBy(F.desc("n"), "item").collect()]
        case "kg", "path":
            found = graph.shortest_paths(spark.read.parquet(triples), a.src, a.dst).limit(10)
            lines = [r["p"] for r in found.select(phrases.path_text(F.col("start"), F.col("path")).alias("p")).collect()]
        case _:
            lines = [r["subject"] for r in T.subjects_with(spark.read.parquet(triples), a.relation, a.object).orderBy("subject").collect()]
    print("\n".join(lines))
    return lines


if __name__ == "__main__":
    main()
