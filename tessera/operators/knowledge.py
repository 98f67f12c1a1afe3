"""Knowledge graphs and models together: builds, predicted links, linked looks, told paths, judged answers.

Models are asked row by row on the executors (``models.chatted``); everything around them is relational.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import naming, phrases, prompts
from tessera.functions import text as X
from tessera.operators import context, evaluation, graph, perception, retrieval, supervision, vectors
from tessera.operators import triples as T
from tessera.operators.models import LanguageModel, chatted
from tessera.sources.storage import materialise

PREDICTED = "llm_predicted"
#: Replies of one document that keep their order.
WINDOWS = 100_000


def build_graph(docs: DataFrame, model: LanguageModel, stored: DataFrame | None = None, windows_per_doc: int | None = 4, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(new triples, per document (ord, title, added)) from documents (ord, title, text).

    A document is read in overlapping windows of characters, the first ``windows_per_doc`` of them (None: all); the
    triples a model finds there are canonicalised, and those that neither the store nor an earlier window has are
    new. ``added`` counts them by the document that had them first. ``limit`` takes the first documents by ``ord``.
    """
    docs = docs.orderBy("ord").limit(limit) if limit is not None else docs
    windows = docs.select("ord", "title", F.inline(X.char_windows(F.col("text"), most=windows_per_doc)))
    asked = windows.select((F.col("ord") * WINDOWS + F.col("i")).alias("ord"), F.col("title"), prompts.extraction(F.col("window"), F.col("title")).alias("messages"))
    replies = chatted(asked, "messages", model)
    found = materialise(T.canonical_triples(perception.parse_triples(replies, "reply", "title")), "found")
    new = T.first_per_key(found) if stored is None else T.insert_new(stored, found)
    per = new.groupBy(F.expr(f"ord div {WINDOWS * perception.PER_REPLY}").alias("ord")).agg(F.count("*").alias("added"))
    return new, docs.select("ord", "title").join(per, "ord", "left").select("ord", "title", F.coalesce("added", F.lit(0)).alias("added"))


def build_stats(per_doc: DataFrame) -> DataFrame:
    """One row (docs, triples_added)."""
    return per_doc.agg(F.count("*").alias("docs"), F.coalesce(F.sum("added"), F.lit(0)).alias("triples_added"))


def look_stats(looks: DataFrame, added: DataFrame) -> DataFrame:
    """(designer, looks, captions, triples_added) of parsed looks (designer, look) and new triples of them."""
    told = looks.groupBy("designer").agg(F.count("*").alias("looks"), F.sum((F.col("look.caption") != "").cast("long")).alias("captions"))
    by = added.groupBy(F.col("subject").alias("designer")).agg(F.count("*").alias("triples_added"))
    return told.join(by, "designer", "left").withColumn("triples_added", F.coalesce("triples_added", F.lit(0)))


def entity_keys(names: DataFrame, unaccent: bool = True) -> DataFrame:
    """``names(entity)`` with ``key``."""
    return names.withColumn("key", naming.canonical_entity(F.col("entity"), unaccent))


def facts_of(keys: DataFrame, triples: DataFrame, limit: int = 25) -> DataFrame:
    """(key, facts array<string>) of ``keys(key)``: facts with the key on either side, the first ``limit`` by ``ord``."""
    cols = ("ord", "subject", "relation", "object")
    sides = triples.select(F.col("subject_key").alias("key"), *cols).unionByName(triples.filter("object_key <> subject_key").select(F.col("object_key").alias("key"), *cols))
    nth = F.row_number().over(W.partitionBy("key").orderBy("ord"))
    few = sides.join(keys.select("key").distinct(), "key", "left_semi").withColumn("nth", nth).filter(F.col("nth") <= limit)
    told = F.struct("nth", phrases.fact_text(F.col("subject"), F.col("relation"), F.col("object")).alias("fact"))
    return few.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(told)), lambda s: s["fact"]).alias("facts"))


def predict_links(names: DataFrame, triples: DataFrame, model: LanguageModel, k: int = 5, unaccent: bool = True) -> DataFrame:
    """New triples that a model expects of ``names(ord, entity)``: about the entity, valid, not stored, the first ``k`` each."""
    none = F.array().cast("array<string>")
    keyed = entity_keys(names, unaccent)
    known = keyed.join(facts_of(keyed, triples, 30), "key", "left").withColumn("facts", F.coalesce("facts", none))
    asked = known.select("ord", "key", F.lit(PREDICTED).alias("source"), prompts.prediction(F.col("entity"), F.col("facts"), k).alias("messages"))
    replies = materialise(chatted(asked, "messages", model), "replies")
    said = T.with_keys(perception.parse_triples(replies, "reply", "source"), unaccent).filter("valid").drop("valid")
    about = said.join(replies.select((F.col("ord") * perception.PER_REPLY).alias("base"), F.col("key").alias("of")), F.col("subject_key") == F.col("of")).filter(F.expr(f"ord div {perception.PER_REPLY} * {perception.PER_REPLY} = base"))
    return T.new_candidates(about.select(*T.COLUMNS), triples, k)


def add_fabrics(fabrics: DataFrame, path: str, unaccent: bool = True) -> int:
    """Inserts an ontology's triples into the stored graph at ``path``; how many were new. A second run adds none."""
    from tessera.sources.sinks import append_triples

    return append_triples(T.canonical_triples(T.fabric_triples(fabrics), unaccent), path)


def entity_prototypes(triples: DataFrame, encoder: retrieval.Encoder, **options) -> DataFrame:
    """(label, centroid): the encoded descriptors of the entities with most facts."""
    told = T.descriptors(triples, **options)
    return told.select(F.col("subject").alias("label"), encoder(F.col("descriptor")).alias("centroid"))


def link(looks: DataFrame, prototypes: DataFrame, triples: DataFrame, id_col: str, vector_col: str, k: int = 3, facts_per: int = 6, unaccent: bool = True) -> DataFrame:
    """(id, rank, entity, score, facts): the nearest entities of each look with their first facts."""
    near = vectors.nearest_prototypes(looks, prototypes, id_col, vector_col, k).withColumnRenamed("label", "entity")
    keyed = entity_keys(near.select("entity").distinct(), unaccent)
    told = keyed.join(facts_of(keyed, triples, facts_per), "key", "left")
    return near.join(told, "entity", "left").select("id", "rank", "entity", "score", F.coalesce("facts", F.array().cast("array<string>")).alias("facts"))


def house_pairs(houses: DataFrame, seed: int = 42) -> DataFrame:
    """(a, b, draw): each two of ``houses(place, house)`` once, the earlier first, with their seeded order.

    Pairs of houses are what the operator is about; the list is a curated one of some dozens.
    """
    x, y = houses.select(F.col("place").alias("p"), F.col("house").alias("a")), houses.select(F.col("place").alias("q"), F.col("house").alias("b"))
    return x.join(y, F.col("p") < F.col("q")).select("a", "b", evaluation.hash_order(F.concat_ws("|", "a", "b"), seed).alias("draw"))


def path_questions(triples: DataFrame, houses: DataFrame, max_pairs: int = 60, max_hops: int = 3, seed: int = 42, unaccent: bool = True) -> DataFrame:
    """(a, b, hops, user, assistant) of house pairs that a telling path joins: one example a pair, the first in seeded order.

    A path tells something if all its relations are of the meaningful ones and no name on it is a hedge.
    """
    pairs = house_pairs(houses, seed)
    keyed = pairs.withColumns({"src": naming.canonical_entity(F.col("a"), unaccent), "dst": naming.canonical_entity(F.col("b"), unaccent)})
    paths = graph.paths_between(triples, keyed.select("src", "dst").distinct(), max_hops)
    good = paths.filter(supervision.tellable(F.col("path")) & ~F.lower("start").contains("not specified"))
    first = good.groupBy("src", "dst").agg(F.min(F.struct("trail", "start", "path", "hops")).alias("m"))
    told = phrases.path_text(F.col("m.start"), F.col("m.path"))
    rows = keyed.join(first, ["src", "dst"]).select("a", "b", "draw", F.col("m.hops").alias("hops"), told.alias("p"))
    rows = rows.orderBy("draw", "a", "b").limit(max_pairs)
    return rows.select("a", "b", "hops", phrases.filled("How are {a} and {b} connected in the world of fashion?", a=F.col("a"), b=F.col("b")).alias("user"), phrases.filled("They connect through the graph: {p}.", p=F.col("p")).alias("assistant"))


def judged(rows: DataFrame, model: LanguageModel, question: str, kg: str, rag: str, key: str, seed: int = 42) -> DataFrame:
    """``rows`` with ``judge`` (kg, rag or tie): the arms come blind, in an order that a hash of ``key`` gives."""
    kg_is_a = F.conv(F.substring(evaluation.hash_order(F.col(key), seed), 1, 1), 16, 10).cast("int") % 2 == 0
    a, b = F.when(kg_is_a, F.col(kg)).otherwise(F.col(rag)), F.when(kg_is_a, F.col(rag)).otherwise(F.col(kg))
    asked = rows.withColumns({"__kg_is_a": kg_is_a, "__messages": prompts.judgement(F.col(question), a, b)})
    replied = chatted(asked, "__messages", model, "__reply")
    return replied.withColumn("judge", phrases.unblinded(phrases.verdict(F.col("__reply")), F.col("__kg_is_a"))).drop("__kg_is_a", "__messages", "__reply")


def answers_of_arms(triples: DataFrame, model: LanguageModel, store: DataFrame | None = None, encoder: retrieval.Encoder | None = None, n_entities: int = 8, passages: int = 5, judge: bool = False, seed: int = 42) -> DataFrame:
    """(entity, n_gold, coverage_kg, coverage_rag, judge) of the entities with most facts.

    Both arms answer the same question from the same passages; one has the entity's facts too. Coverage is the share
    of the entity's objects that an answer names.
    """
    top = T.top_subjects(triples, n_entities).select(F.col("subject_key").alias("key"), F.col("subject").alias("entity"), F.row_number().over(W.orderBy(F.desc("n_facts"), "subject_key")).alias("id"))  # n_entities rows
    gold = triples.join(top.select(F.col("key").alias("subject_key")), "subject_key", "left_semi").groupBy(F.col("subject_key").alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "object"))), lambda s: s["object"]).alias("gold"))
    rows = materialise(top.join(gold, "key").join(facts_of(top, triples, 20), "key", "left").withColumn("question", prompts.key_facts_question(F.col("entity"))), "entities")
    empty = F.lit("").alias("passages")
    if store is None:
        rows = rows.withColumn("passages", F.lit(""))
    else:
        hits = retrieval.retrieve(store, rows.select("id", F.concat_ws(" ", "entity", "question").alias("query")), encoder or retrieval.hashing_encoder(), passages)
        hits = hits.withColumn("line", phrases.passage_line(F.lit(None).cast("string"), F.col("source"), F.col("document")))
        # retrieval asks by a hash of the id
        lines = context.within_budget(hits, "query_id", "rank", "line").groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda s: s["line"]), "\n").alias("passages"))
        rows = rows.join(lines, F.col("id") == F.col("query_id"), "left").drop("query_id").withColumn("passages", F.coalesce("passages", empty))
    none = F.array().cast("array<string>")
    arms = {"kg": phrases.knowledge_block(F.coalesce("facts", none), F.col("passages")), "rag": phrases.knowledge_block(none, F.col("passages"))}
    for arm, block in arms.items():
        rows = chatted(rows.withColumn("__m", prompts.grounded_answer(F.col("question"), block)), "__m", model, arm).drop("__m")
    rows = materialise(rows, "answers")
    out = judged(rows, model, "question", "kg", "rag", "entity", seed) if judge else rows.withColumn("judge", F.lit(""))
    cover = lambda arm: F.round(phrases.coverage(F.col(arm), F.col("gold")), 3).alias(f"coverage_{arm}")
    return out.select("entity", F.size("gold").alias("n_gold"), cover("kg"), cover("rag"), "judge")


def lift_summary(results: DataFrame) -> DataFrame:
    """One row: entities, mean coverages, lift and the judge's tally of ``answers_of_arms``."""
    wins = lambda arm: F.coalesce(F.sum((F.col("judge") == arm).cast("long")), F.lit(0)).alias(f"judge_{arm}")
    mean: dict[str, Column] = {arm: F.coalesce(F.round(F.avg(f"coverage_{arm}"), 3), F.lit(0.0)) for arm in ("kg", "rag")}
    off = F.coalesce(F.round(F.avg("coverage_kg") - F.avg("coverage_rag"), 3), F.lit(0.0))
    return results.agg(F.count("*").alias("entities_tested"), mean["kg"].alias("mean_coverage_kg"), mean["rag"].alias("mean_coverage_rag"), off.alias("lift"), wins("kg"), wins("rag"), wins("tie"))
