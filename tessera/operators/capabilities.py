"""What a request is answered with: intents to capabilities, contexts to prompts, replies with their sources."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import phrases, prompts
from tessera.operators import context, perception, retrieval, training, vectors
from tessera.operators import triples as T
from tessera.operators.models import LanguageModel

#: The onboarding answers a brand is built from, and those that make its retrieval query.
BRAND_ANSWERS = ("working_name", "category", "audience", "price_tier", "aesthetic", "values", "signature", "palette", "inspirations", "differentiator")


@dataclass
class Result:
    text: str
    sources: list[str] = field(default_factory=list)


@dataclass
class Knowledge:
    """A chunk store and a triple table; either may be missing, and a context then does without."""

    store: DataFrame | None = None
    triples: DataFrame | None = None
    encoder: retrieval.Encoder = field(default_factory=retrieval.hashing_encoder)
    budget: int = 2000

    def ground(self, spark: SparkSession, query: str, n: int = 5) -> tuple[str, list[str]]:
        """(knowledge block, sources) of one query. What reaches the driver is n passages and 20 facts at most."""
        asked = spark.createDataFrame([(0, query)], "id long, query string")
        facts, lines, sources = [], [], []
        if self.triples is not None:
            matched = context.matched_entities(asked, T.entities(self.triples), "id", "query")
            facts = [r["fact"] for r in context.entity_facts(matched, self.triples).orderBy("place").collect()]
        if self.store is not None:
            hits = retrieval.retrieve(self.store, asked, self.encoder, n)
            line = phrases.passage_line(F.lit(None).cast("string"), F.col("source"), F.col("document"))
            rows = context.within_budget(hits.withColumn("line", line), "query_id", "rank", "line", self.budget).orderBy("rank").collect()
            lines, sources = [r["line"] for r in rows], sorted({r["source"] for r in rows})
        block = spark.createDataFrame([(facts, "\n".join(lines))], "f array<string>, p string").select(phrases.knowledge_block(F.col("f"), F.col("p")).alias("b")).first()["b"]
        return block, sources


class Capability(Protocol):
    def run(self, spark: SparkSession, request: object, depth: str = "detailed", form: str = "report") -> Result: ...


@dataclass
class Grounded:
    """A capability that turns a request into a query, grounds it and asks the model."""

    model: LanguageModel
    knowledge: Knowledge
    task: str
    passages: int = 5

    def query(self, request: object) -> str:
        return str(request)

    def told(self, request: object) -> str:
        return str(request)

    def run(self, spark: SparkSession, request: object, depth: str = "detailed", form: str = "report") -> Result:
        block, sources = self.knowledge.ground(spark, self.query(request), self.passages)
        prompt = "\n\n".join(x for x in (self.task, self.told(request), block) if x)
        return Result(self.model.complete(prompt, phrases.directive(depth, form)), sources)


class BrandFoundation(Grounded):
    """From onboarding answers (a dict) or one idea (a string, taken as the aesthetic)."""

    def answers(self, request: object) -> dict[str, str]:
        return {k: str(v) for k, v in request.items()} if isinstance(request, dict) else {"aesthetic": str(request)}

    def query(self, request: object) -> str:
        given = self.answers(request)
        return " ".join(given[k] for k in prompts.BRAND_QUERY if given.get(k)).strip() or prompts.BRAND_FALLBACK

    def told(self, request: object) -> str:
        given = self.answers(request)
        return "\n".join(f"{k}: {given[k]}" for k in BRAND_ANSWERS if given.get(k))


class TopicAnalysis(Grounded):
    """A topic, or a dict that names one as ``topic`` or ``query``."""

    def query(self, request: object) -> str:
        return str(request.get("topic") or request.get("query") or request) if isinstance(request, dict) else str(request)

    told = query


@dataclass
class Seen:
    """What the parts at hand make of a picture; what failed or is missing is empty."""

    garments: list[str] = field(default_factory=list)
    score: int | None = None
    similar: list[str] = field(default_factory=list)
    movements: list[str] = field(default_factory=list)
    lineage: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)


def see(spark: SparkSession, stack: perception.Stack, image: bytes, nearest: int = 5) -> Seen:
    """Looks at one picture with the parts of ``stack``.

    Parts: ``segmenter`` (see perception), ``embedder`` (bytes to a list of floats), ``index`` (row, embedding, meta),
    ``head`` (arrays of a scorer), ``movements`` and ``runway`` (prototype tables label, centroid). The picture is
    embedded once; a part that fails leaves a note.
    """
    seen = Seen()

    def attempt(name: str, f):
        try:
            return f()
        except Exception as e:  # noqa: BLE001  a part that fails is done without
            seen.notes.append(f"{name} failed: {e}")
            return None

    if stack.segmenter is not None:
        pixels = lambda: perception.pixel_labels(spark.createDataFrame([(0, bytearray(image))], "image long, content binary"), stack.segmenter)
        seen.garments = attempt("segmenter", lambda: [r["label"] for r in perception.regions(pixels()).orderBy("place").collect()]) or []
    vector = attempt("embedder", lambda: [float(x) for x in stack.embedder(image)]) if stack.embedder is not None else None
    if vector is None:
        return seen
    asked = spark.createDataFrame([(0, vector)], "row long, embedding array<double>")

    def near(prototypes: DataFrame) -> list[str]:
        return [r["label"] for r in vectors.nearest_prototypes(asked, prototypes, "row", "embedding").orderBy("rank").collect()]

    if stack.index is not None:
        hits = lambda: vectors.top_k(asked, stack.index, nearest, "row", "embedding", row_cols=("meta",)).orderBy("rank").collect()
        seen.similar = attempt("index", lambda: [" ".join(v for k, v in sorted(r["meta"].items()) if k in ("title", "label", "designer", "show") and v) for r in hits()]) or []
    if stack.head is not None:
        unit = np.array(vector) / max(float(np.linalg.norm(vector)), 1e-8)
        seen.score = attempt("head", lambda: round(100 / (1 + float(np.exp(-training.mlp_scores(unit, stack.head)[0][0])))))
    if stack.movements is not None:
        seen.movements = attempt("movements", lambda: near(stack.movements)) or []
    if stack.runway is not None:
        seen.lineage = attempt("runway", lambda: near(stack.runway)) or []
    return seen


@dataclass
class LookReview(Grounded):
    """A picture (bytes), or a dict of ``image`` and ``occasion``: what is seen of it, then advice."""

    stack: perception.Stack = field(default_factory=perception.Stack)

    def parsed(self, request: object) -> tuple[bytes, str]:
        image, occasion = (request.get("image"), str(request.get("occasion", ""))) if isinstance(request, dict) else (request, "")
        if not image:
            raise FileNotFoundError("no image")
        return bytes(image), occasion

    def run(self, spark: SparkSession, request: object, depth: str = "detailed", form: str = "report") -> Result:
        image, occasion = self.parsed(request)
        seen = see(spark, self.stack, image)
        one = spark.createDataFrame([(seen.garments, occasion, seen.lineage + seen.movements)], "g array<string>, o string, l array<string>")
        asked = one.select(prompts.look_query(F.col("g"), F.col("o")).alias("q")).first()["q"]
        block, sources = self.knowledge.ground(spark, asked, self.passages)
        message = one.select(prompts.look_review(F.col("g"), F.col("o"), F.col("l"), F.lit(block), phrases.directive(depth, form)).alias("m")).first()["m"]
        system, user = (m["content"] for m in message)
        score = f"Learned score: {seen.score}/100.\n\n" if seen.score is not None else ""
        return Result(self.model.complete(score + user, system), sorted({*sources, *filter(None, seen.similar)}))


def standard(model: LanguageModel, knowledge: Knowledge, stack: perception.Stack | None = None) -> dict[str, Capability]:
    return {
        "bootstrap": BrandFoundation(model, knowledge, "Write a brand foundation from these answers.", 6),
        "analyze": TopicAnalysis(model, knowledge, "Analyse this topic from the knowledge given.", 8),
        "style": LookReview(model, knowledge, "Review this look for the occasion.", stack=stack or perception.Stack()),
    }


def route(spark: SparkSession, capabilities: dict[str, Capability], query: str, **options: str) -> tuple[str, Result]:
    """(intent, result) of the capability that is registered for the query's intent; LookupError if there is none."""
    intent = context.classify(spark.createDataFrame([(query,)], "q string"), "q").first()["intent"]
    if intent not in capabilities:
        raise LookupError(f"no capability for {intent!r}")
    return intent, capabilities[intent].run(spark, query, **options)
