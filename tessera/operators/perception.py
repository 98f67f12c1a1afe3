"""Structured replies and images: parsed triples and looks, garment regions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import naming
from tessera.operators.triples import said_once

#: Garment labels that are kept, and the least share of the picture.
GARMENTS = ("Hat", "Upper-clothes", "Skirt", "Pants", "Dress", "Belt", "Left-shoe", "Right-shoe", "Bag", "Scarf", "Sunglasses")
MIN_AREA = 0.02
LOOK_LISTS = ("silhouettes", "materials", "aesthetics", "garments", "palette")
#: Triples of one reply that keep their order.
PER_REPLY = 10_000
TRIPLE_JSON = "array<struct<subject:string,subject_type:string,relation:string,object:string,object_type:string>>"


def parse_triples(replies: DataFrame, raw_col: str, source_col: str) -> DataFrame:
    """(ord, subject, ..., source) of the JSON list that a reply holds; feed it to canonical_triples.

    The list reaches from the first ``[`` to the last ``]``. What cannot be read gives no rows, an unknown relation
    drops its triple. ``ord`` is the reply's ``ord`` and the place in its list.
    """
    block = F.regexp_extract(F.coalesce(F.col(raw_col), F.lit("")), r"(?s)\[.*\]", 0)
    parsed = F.from_json(F.when(block != "", block), TRIPLE_JSON)
    rows = replies.select(F.col("ord").alias("reply"), F.col(source_col).alias("source"), F.posexplode(parsed).alias("i", "t")).filter("t IS NOT NULL")
    text = lambda name: F.trim(F.coalesce(F.col(f"t.{name}"), F.lit("")))
    out = rows.select((F.col("reply") * PER_REPLY + F.col("i")).alias("ord"), text("subject").alias("subject"), naming.canonical_relation(text("relation")).alias("relation"), text("object").alias("object"), F.lower(text("subject_type")).alias("subject_type"), F.lower(text("object_type")).alias("object_type"), "source")
    return out.filter("relation <> ''")


def _strings(json: Column, name: str) -> Column:
    """A field that is a list or one string, as up to six stripped strings; null and missing count as empty."""
    raw = F.get_json_object(json, f"$.{name}")
    listed = F.from_json(raw, "array<string>")
    items = F.when(raw.isNull(), F.array().cast("array<string>")).when(raw.startswith("["), listed).otherwise(F.array(raw))
    clean = F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.slice(clean, 1, 6)


def parse_look(raw: Column) -> Column:
    """struct<caption, silhouettes, materials, aesthetics, garments, palette> of the JSON object in a reply; empty on failure."""
    block = F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?s)\{.*\}", 0)
    fine = F.when(F.get_json_object(block, "$").isNotNull(), block)
    return F.struct(F.trim(F.coalesce(F.get_json_object(fine, "$.caption"), F.lit(""))).alias("caption"), *(_strings(fine, n).alias(n) for n in LOOK_LISTS))


def look_triples(looks: DataFrame, look_col: str = "look") -> DataFrame:
    """Raw triples of (ord, designer, season, look struct): silhouettes, materials, aesthetics and the season, each fact once."""
    fields = (("has_silhouette", "silhouettes", "silhouette"), ("uses_material", "materials", "material"), ("known_for", "aesthetics", "aesthetic"))

    def told(relation: str, name: str, kind: str) -> Column:
        return F.transform(F.col(f"{look_col}.{name}"), lambda x: F.struct(F.lit(relation).alias("relation"), x.alias("object"), F.lit(kind).alias("object_type")))

    parts = [told(*f) for f in fields]
    era = F.when(F.coalesce(F.col("season"), F.lit("")) != "", F.array(F.struct(F.lit("from_era").alias("relation"), F.col("season").alias("object"), F.lit("era").alias("object_type")))).otherwise(F.array().cast("array<struct<relation:string,object:string,object_type:string>>"))
    rows = looks.select("ord", F.col("designer").alias("subject"), F.posexplode(F.concat(*parts, era)).alias("i", "t"))
    return said_once(rows.select((F.col("ord") * 100 + F.col("i")).alias("ord"), "subject", "t.relation", "t.object", F.lit("designer").alias("subject_type"), "t.object_type", F.lit("vlm_runway").alias("source")))


def regions(pixels: DataFrame, by: str = "image", labels: tuple[str, ...] = GARMENTS, min_area: float = MIN_AREA) -> DataFrame:
    """(by, label, area, x0, y0, x1, y1, place) of a pixel table (by, y, x, label): kept labels of some size, largest first."""
    from pyspark.sql import Window as W

    counts = pixels.groupBy(by, "label").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))
    area = F.col("n") / F.sum("n").over(W.partitionBy(by))
    kept = counts.withColumn("area", area).filter(F.col("label").isin(*labels) & (F.col("area") >= min_area))
    return kept.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(F.desc("area"), "label"))).drop("n")


class Segmenter(Protocol):
    """What tells an image's pixels apart; it runs on the executors, so it must be picklable."""

    def segment(self, image: bytes) -> list[list[str]]: ...


def pixel_labels(images: DataFrame, segmenter: Segmenter, id_col: str = "image", content_col: str = "content") -> DataFrame:
    """(image, y, x, label) of a segmenter's label maps; an image it cannot read has no pixels."""
    kind = dict(images.dtypes)[id_col]

    def run(batches):
        for b in batches:
            rows = []
            for i, content in zip(*(b.column(c).to_pylist() for c in (0, 1))):
                try:
                    grid = segmenter.segment(content)
                except Exception:  # noqa: BLE001  any failure of a model
                    continue
                rows += [(i, y, x, label) for y, line in enumerate(grid) for x, label in enumerate(line)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((b.schema.types[0], pa.int64(), pa.int64(), pa.string()))], names=["image", "y", "x", "label"])

    return images.select(id_col, content_col).mapInArrow(run, f"image {kind}, y long, x long, label string")


@dataclass
class Stack:
    """The parts that look at images; each may be missing, and what needs it then does without."""

    parts: dict[str, object] = field(default_factory=dict)
    notes: list[str] = field(default_factory=list)

    def __getattr__(self, name: str) -> object | None:
        return self.__dict__.get("parts", {}).get(name)


def build_stack(loaders: dict[str, tuple[tuple[str, ...], Callable[[Stack], object]]]) -> Stack:
    """Loads parts in the order given: name -> (parts it needs, loader). A part that fails or lacks one it needs is None, with a note."""
    stack = Stack()
    for name, (needs, load) in loaders.items():
        missing = [n for n in needs if stack.parts.get(n) is None]
        try:
            stack.parts[name] = None if missing else load(stack)
        except Exception as e:  # noqa: BLE001  a part that cannot be loaded is done without
            stack.parts[name] = None
            stack.notes.append(f"{name} unavailable: {e}")
        if missing:
            stack.notes.append(f"{name} needs {', '.join(missing)}")
    return stack
