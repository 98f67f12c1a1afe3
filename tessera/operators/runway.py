"""Pictures at work: embedding tables of images, captioning a runway archive step by step, recognising houses.

Models that look at pictures are callables that run on the executors: an ``Embedder`` turns bytes into a vector, a
``Describer`` answers a prompt about a picture. What fails for one picture leaves that picture out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import prompts
from tessera.operators import evaluation, knowledge, perception, vectors
from tessera.operators import triples as T
from tessera.sources import sinks
from tessera.sources.storage import materialise

#: bytes to a vector; (picture, prompt, system) to a reply.
Embedder = Callable[[bytes], list[float]]
Describer = Callable[[bytes, str, str], str]
CAPTIONS = "look string, designer string, show string, caption string"


def embedded(images: DataFrame, embedder: Embedder, image_col: str = "image") -> DataFrame:
    """``images`` with ``embedding`` in place of the picture; null pictures and those the model fails on are left out."""
    kept = [c for c in images.columns if c != image_col]
    schema = ", ".join([*(f"`{c}` {dict(images.dtypes)[c]}" for c in kept), "embedding array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors_, at = [], []
            for i, content in enumerate(b.column(len(kept)).to_pylist()):
                try:
                    vectors_.append([float(x) for x in embedder(content)] if content is not None else None)
                except Exception:  # noqa: BLE001  any failure of a model
                    vectors_.append(None)
                if vectors_[-1] is not None:
                    at.append(i)
            some = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(some) for c in b.columns[: len(kept)]), pa.array([vectors_[i] for i in at], pa.list_(pa.float64()))], names=[*kept, "embedding"])

    return images.select(*(F.col(f"`{c}`") for c in kept), image_col).mapInArrow(run, schema)


def first_per_collection(looks: DataFrame, n: int, collection: tuple[str, ...] = ("designer", "show"), order: str = "look") -> DataFrame:
    """The first ``n`` looks of each collection by ``order``."""
    nth = F.row_number().over(W.partitionBy(*collection).orderBy(order))
    return looks.withColumn("__nth", nth).filter(F.col("__nth") <= n).drop("__nth")


def described(looks: DataFrame, describer: Describer) -> DataFrame:
    """``looks(look, designer, show, season, image)`` with ``reply`` instead of the picture; failures are left out."""
    kept = ("look", "designer", "show", "season")
    asked = looks.select(*kept, prompts.look(F.col("designer"), F.col("show")).alias("m"), "image")
    said = lambda i: F.element_at("m", i)["content"]
    asked = asked.select(*kept, said(1).alias("system"), said(2).alias("prompt"), "image")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, replies = [], []
            for i, (system, prompt, image) in enumerate(zip(*(b.column(c).to_pylist() for c in ("system", "prompt", "image")))):
                try:
                    replies.append(str(describer(image, prompt, system)))
                    at.append(i)
                except Exception:  # noqa: BLE001  any failure of an outside service
                    continue
            some = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(some) for c in kept), pa.array(replies, pa.string())], names=[*kept, "reply"])

    return asked.mapInArrow(run, "look string, designer string, show string, season string, reply string")


def extract(looks: DataFrame, describer: Describer, captions: str, triples: str, per_collection: int | None = 3, limit: int | None = None, unaccent: bool = True) -> DataFrame:
    """(designer, looks, captions, triples_added) of a run over ``looks(look, designer, show, season, image)``.

    Looks whose caption is stored are passed over, so a run that broke off is gone on with by running it again; the
    model is asked once for each other look. Triples are inserted first and only if new, then captions are appended: a
    look counts as done when both are stored. ``per_collection`` looks of each collection are taken, ``limit`` in all,
    in the order of ``look``; None takes all. Pictures the model fails on are tried again by the next run.
    """
    spark = looks.sparkSession
    taken = looks if per_collection is None else first_per_collection(looks, per_collection)
    stored = sinks.stored_json(spark, captions, CAPTIONS)
    left = taken if stored is None else taken.join(stored.select("look").distinct(), "look", "left_anti")
    left = left.orderBy("look").limit(limit) if limit is not None else left
    replies = materialise(described(left, describer), "replies")
    parsed = replies.withColumns({"look_": perception.parse_look(F.col("reply")), "ord": F.pmod(F.xxhash64("look"), F.lit(1 << 50))})
    raw = perception.look_triples(parsed.select("ord", "designer", "season", F.col("look_").alias("look")))
    known = sinks.open_triples(spark, triples)
    new = materialise(T.insert_new(known, T.canonical_triples(raw, unaccent)), "new")
    sinks.append_triples(new, triples)
    rows = parsed.select("look", "designer", "show", F.col("look_.caption").alias("caption"))
    sinks.append_captions(rows, captions)
    return knowledge.look_stats(parsed.select("designer", F.col("look_").alias("look")), new)


def recognition(index: DataFrame, id_col: str = "look", label_col: str = "designer", collection: tuple[str, ...] = ("designer", "show"), frac: float = 0.2, neighbours: int = 10, iterations: int | None = 2000, seed: int = 42) -> DataFrame:
    """``vectors.accuracy_report`` of houses voted by the nearest looks, whole collections held out."""
    key = F.concat_ws("|", *collection)
    rows = index.withColumn("__id", F.xxhash64(F.col(id_col)))
    split = evaluation.split(rows, key, frac, seed)
    return vectors.accuracy_report(split, F.col("held_out"), "__id", label_col, "embedding", neighbours, "group", iterations)
