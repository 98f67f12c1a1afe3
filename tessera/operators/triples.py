"""The triple store as DataFrames: canonicalise, validate, insert, look up, aggregate.

A triple table has ``ord`` (its place in insertion order), subject, relation, object, subject_type, object_type,
source, subject_key and object_key. Insertion order stands for the order that an unordered look-up would return.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import naming, phrases

COLUMNS = ("ord", "subject", "relation", "object", "subject_type", "object_type", "source", "subject_key", "object_key")
KEY = ("subject_key", "relation", "object_key")


def canonical_names(names: DataFrame, unaccent: bool = True) -> DataFrame:
    """(name, key, fine) of ``names(name)``: canonical key, and whether a triple may have the name."""
    plain = names.select("name", naming.normalize_entity(F.col("name"), unaccent).alias("plain"))
    return plain.select("name", naming.canonical_key(F.col("plain")).alias("key"), ((F.trim("name") != "") & naming.is_plausible(F.col("plain"))).alias("fine"))


def with_keys(raw: DataFrame, unaccent: bool = True) -> DataFrame:
    """Adds canonical keys and ``valid``; relations are mapped to the vocabulary (empty if unknown), types to lower case.

    Names are canonicalised once each and joined, for triples are many and names few. A triple is valid if its names
    are plausible and not blank, its relation is known and it is no loop.
    """
    typed = raw.withColumns({"relation": naming.canonical_relation(F.col("relation")), "subject_type": F.lower(F.trim("subject_type")), "object_type": F.lower(F.trim("object_type"))})
    names = canonical_names(raw.select(F.col("subject").alias("name")).union(raw.select("object")).distinct(), unaccent)
    for side in ("subject", "object"):
        typed = typed.join(names.select(F.col("name").alias(side), F.col("key").alias(f"{side}_key"), F.col("fine").alias(f"{side}_fine")), side, "left")
    valid = F.col("subject_fine") & F.col("object_fine") & F.col("relation").isin(*naming.RELATIONS) & (F.col("subject_key") != F.col("object_key"))
    return typed.withColumn("valid", F.coalesce(valid, F.lit(False))).drop("subject_fine", "object_fine")


def first_per_key(triples: DataFrame) -> DataFrame:
    """The first triple of each key by ``ord``: an aggregate, so that a common key is reduced before the shuffle."""
    rest = [c for c in triples.columns if c not in KEY and c != "ord"]
    best = triples.groupBy(*KEY).agg(F.min_by(F.struct(*rest), "ord").alias("r"), F.min("ord").alias("ord"))
    return best.select("ord", *(F.col(f"r.{c}").alias(c) for c in rest), *KEY).select(*[c for c in COLUMNS if c in {"ord", *rest, *KEY}])


def said_once(raw: DataFrame) -> DataFrame:
    """Rows that differ in ``ord`` alone as the first of them: the hash aggregate leaves each task as few rows as there are facts.

    ``first_per_key`` keeps the same rows, but it sorts all that it gets in every task.
    """
    return raw.groupBy(*(c for c in raw.columns if c != "ord")).agg(F.min("ord").alias("ord")).select(*raw.columns)


def canonical_triples(raw: DataFrame, unaccent: bool = True) -> DataFrame:
    """Raw (ord, subject, relation, object, subject_type, object_type, source) as a valid, distinct triple table."""
    return first_per_key(with_keys(raw, unaccent).filter("valid").drop("valid"))


def insert_new(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of ``new`` whose key is not stored yet; append them to the store."""
    return first_per_key(new).join(stored.select(*KEY), list(KEY), "left_anti").select(*COLUMNS)


def neighbors(triples: DataFrame, entity: str, limit: int = 50) -> DataFrame:
    """Facts with the entity on either side, in insertion order."""
    return edges_of(triples, naming.canonical_entity(F.lit(entity), unaccent=not entity.isascii())).orderBy("ord").limit(limit)


def edges_of(triples: DataFrame, key: Column | str) -> DataFrame:
    key = F.lit(key) if isinstance(key, str) else key
    return triples.filter((F.col("subject_key") == key) | (F.col("object_key") == key))


def outgoing(triples: DataFrame, entity: str) -> DataFrame:
    key = naming.canonical_entity(F.lit(entity), unaccent=not entity.isascii())
    return triples.filter(F.col("subject_key") == key).select("relation", "object", "object_type")


def subjects_with(triples: DataFrame, relation: str, obj: str) -> DataFrame:
    """Distinct surface subjects that have the relation to the object."""
    key = naming.canonical_entity(F.lit(obj), unaccent=not obj.isascii())
    return triples.filter((F.col("relation") == naming.canonical_relation(F.lit(relation))) & (F.col("object_key") == key)).select("subject").distinct()


def objects_of(triples: DataFrame, entity: str, relation: str) -> DataFrame:
    return outgoing(triples, entity).filter(F.col("relation") == relation).select("object")


def facts(triples: DataFrame, entity: str, limit: int = 25) -> DataFrame:
    return neighbors(triples, entity, limit).select(phrases.fact_text(F.col("subject"), F.col("relation"), F.col("object")).alias("fact"))


def top_subjects(triples: DataFrame, n: int = 20) -> DataFrame:
    """(subject, subject_key, n_facts): most facts first, ties by key."""
    return triples.groupBy("subject_key").agg(F.min("subject").alias("subject"), F.count("*").alias("n_facts")).orderBy(F.desc("n_facts"), "subject_key").limit(n)


def entities(triples: DataFrame) -> DataFrame:
    return triples.select(F.col("subject_key").alias("entity")).union(triples.select("object_key")).distinct()


def stats(triples: DataFrame) -> DataFrame:
    """(item, n): triples, entities, and one row for each relation."""
    total = triples.agg(F.count("*").alias("n")).select(F.lit("triples").alias("item"), "n")
    names = entities(triples).agg(F.count("*").alias("n")).select(F.lit("entities").alias("item"), "n")
    by = triples.groupBy("relation").agg(F.count("*").alias("n")).select(F.concat(F.lit("relation:"), "relation").alias("item"), "n")
    return total.unionByName(names).unionByName(by)


def new_candidates(candidates: DataFrame, stored: DataFrame, k: int = 10) -> DataFrame:
    """Link candidates of each subject that are not stored, each once, the first k by ``ord``."""
    fresh = first_per_key(candidates).join(stored.select(*KEY), list(KEY), "left_anti")
    rank = F.row_number().over(W.partitionBy("subject_key").orderBy("ord"))
    return fresh.withColumn("rank", rank).filter(F.col("rank") <= k)


def descriptors(triples: DataFrame, relations: tuple[str, ...] = ("known_for", "has_silhouette", "uses_material", "associated_with", "from_era", "based_in", "influenced_by"), per_relation: int = 3, max_entities: int = 400, min_facts: int = 3) -> DataFrame:
    """(subject, descriptor) of the entities with most facts: their first objects by relation, in a fixed order."""
    top = top_subjects(triples, max_entities).filter(F.col("n_facts") >= min_facts)
    order = F.array_position(F.array(*map(F.lit, relations)), F.col("relation"))
    told = triples.filter(F.col("relation").isin(*relations)).withColumn("place", order)
    nth = F.row_number().over(W.partitionBy("subject_key", "relation").orderBy("ord"))
    few = told.withColumn("nth", nth).filter(F.col("nth") <= per_relation)
    grouped = few.groupBy("subject_key", "place").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "object"))), lambda s: s["object"]), ", ").alias("part"))
    parts = grouped.groupBy("subject_key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "part"))), lambda s: s["part"]), "; ").alias("text"))
    return top.join(parts, "subject_key").select("subject", "n_facts", F.concat("subject", F.lit(" — "), "text").alias("descriptor"))


def fabric_triples(fabrics: DataFrame) -> DataFrame:
    """Triples of an ontology (fabric, weight, drape, warmth, season, texture, properties): raw rows for canonical_triples, each fact once."""
    said = F.concat(
        F.coalesce("properties", F.array().cast("array<string>")),
        F.array_compact(F.array(F.when(F.col("weight") != "", F.concat("weight", F.lit(" weight"))), F.when(F.col("drape") != "", F.concat("drape", F.lit(" drape"))), F.when(F.col("warmth") != "", F.col("warmth")))),
    )
    parts = [(said, "has_property", "property"), (F.col("texture"), "has_texture", "texture"), (F.col("season"), "suits_season", "season")]
    rows = [fabrics.select(F.col("fabric").alias("subject"), F.lit(r).alias("relation"), F.posexplode(v).alias("i", "object"), F.lit("material").alias("subject_type"), F.lit(t).alias("object_type"), F.lit("fabric_ontology").alias("source"), F.lit(n).alias("part")) for n, (v, r, t) in enumerate(parts)]
    out = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return said_once(out.withColumn("ord", F.xxhash64("subject", "part", "i")).drop("i", "part"))
