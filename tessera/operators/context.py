"""Contexts for a reply: entities a query names, passages within a budget, intents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import phrases
from tessera.sources.storage import shared_path

#: The words that speak for an intent, in the intents' order of declaration.
INTENTS = {
    "bootstrap": ("start a brand", "new brand", "brand from scratch", "bootstrap", "launch a label", "found a brand", "co-founder", "my own line"),
    "style": ("what should i wear", "style me", "outfit", "my wardrobe", "look good", "how do i wear", "styling"),
    "analyze": ("trend", "forecast", "analyse", "analyze", "what's popular", "brand dna", "competitor", "cultural"),
    "design": ("design", "generate a", "create a piece", "collection", "remix"),
    "pattern": ("pattern", "sewing", "tech pack", "garment construction"),
    "full_cycle": ("end to end", "full cycle", "everything from", "entire process"),
}
#: Order in which a model's reply is searched for an intent.
REPLY_ORDER = ("analyze", "design", "pattern", "bootstrap", "style", "full_cycle", "unknown")


def classify(queries: DataFrame, text_col: str, keywords: dict[str, tuple[str, ...]] | None = None, reply_col: str | None = None) -> DataFrame:
    """``queries`` with ``intent`` and ``intent_score``: the intent with most keywords in the text, ties by declaration.

    Without any, the first intent named in ``reply_col`` (a model's reply) or ``unknown``. One expression, no join.
    """
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    scores = [(i, sum((low.contains(w).cast("int") for w in words), F.lit(0))) for i, words in (keywords or INTENTS).items()]
    best = F.greatest(*(s for _, s in scores))
    fallback = F.lit("unknown")
    if reply_col:
        reply = F.lower(F.coalesce(F.col(reply_col), F.lit("")))
        for name in reversed(REPLY_ORDER):
            fallback = F.when(reply.contains(name), name).otherwise(fallback)
    pick = F.lit(None).cast("string")
    for name, s in reversed(scores):
        pick = F.when(s == best, name).otherwise(pick)
    return queries.withColumn("intent", F.when(best > 0, pick).otherwise(fallback)).withColumn("intent_score", best)


def matched_entities(queries: DataFrame, entities: DataFrame, id_col: str, text_col: str, most: int = 4, bound: int = 200_000) -> DataFrame:
    """(id, entity, place): entities that a lower-cased text contains, longest first, ties by name; the first ``most``.

    Containment has no key to join on. Up to ``bound`` entities an automaton on the executors finds them in one pass
    over each text; more go in further passes, each with its own block.
    """
    import ahocorasick

    spark = queries.sparkSession
    kind = dict(queries.dtypes)[id_col]
    rows = queries.select(F.col(id_col).alias("id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    names = entities.filter(F.coalesce(F.col("entity"), F.lit("")) != "").toLocalIterator()
    block: list[str] = []

    def search(block: list[str]) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def run(batches):
            import pyarrow as pa

            automaton = ahocorasick.Automaton()
            for n in shared.value:
                automaton.add_word(n, n)
            automaton.make_automaton()
            for b in batches:
                ids, got = [], []
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    best = sorted({n for _, n in automaton.iter(t)}, key=lambda n: (-len(n), n))[:most]
                    ids += [i] * len(best)
                    got += best
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.types[0]), pa.array(got, pa.string())], names=["id", "entity"])

        return rows.mapInArrow(run, f"id {kind}, entity string")

    path = None  # further blocks go to storage one after another, so that one block at a time is broadcast
    for r in names:
        block.append(r["entity"])
        if len(block) == bound:
            path = path or shared_path(spark, "matches")
            search(block).write.mode("append").parquet(path)
            block = []
    if path is not None:
        if block:
            search(block).write.mode("append").parquet(path)
        found = spark.read.schema(f"id {kind}, entity string").parquet(path)
    elif block:
        found = search(block)
    else:
        return spark.createDataFrame([], f"id {kind}, entity string, place int")
    place = F.row_number().over(W.partitionBy("id").orderBy(F.desc(F.length("entity")), "entity"))
    return found.withColumn("place", place).filter(F.col("place") <= most)


def entity_facts(matched: DataFrame, triples: DataFrame, per_entity: int = 25, most: int = 20) -> DataFrame:
    """(id, place, fact): facts of the matched entities in their order, each once, the first ``most``."""
    sides = triples.select(F.col("subject_key").alias("key"), "ord", "subject", "relation", "object").unionByName(triples.filter("object_key <> subject_key").select(F.col("object_key").alias("key"), "ord", "subject", "relation", "object"))
    nth = F.row_number().over(W.partitionBy("key").orderBy("ord"))
    few = sides.join(matched.select(F.col("entity").alias("key")).distinct(), "key", "left_semi").withColumn("nth", nth).filter(F.col("nth") <= per_entity)
    told = matched.join(few, F.col("entity") == F.col("key")).select("id", "place", "nth", phrases.fact_text(F.col("subject"), F.col("relation"), F.col("object")).alias("fact"))
    once = told.groupBy("id", "fact").agg(F.min(F.struct("place", "nth")).alias("at"))
    rank = F.row_number().over(W.partitionBy("id").orderBy("at"))
    return once.withColumn("place", rank).filter(F.col("place") <= most).select("id", "place", "fact")


def within_budget(passages: DataFrame, by: str, order: str, line_col: str, budget: int = 2000) -> DataFrame:
    """Passages in order while the running length of their lines stays within the budget.

    Each line takes a character at least, so ``budget`` lines of a group can fit; Spark keeps those by each task before
    the shuffle, and a group of any size meets as that many rows.
    """
    nth = F.row_number().over(W.partitionBy(by).orderBy(order))
    few = passages.filter(F.length(line_col) > 0).withColumn("__nth", nth).filter(F.col("__nth") <= budget)
    running = F.sum(F.length(line_col)).over(W.partitionBy(by).orderBy("__nth").rowsBetween(W.unboundedPreceding, 0))
    return few.withColumn("running", running).filter(F.col("running") <= budget).drop("__nth")


def answer_sources(hits: DataFrame, by: str, title_col: str, source_col: str) -> DataFrame:
    """(by, sources): distinct titles, or sources where there is none, sorted."""
    name = F.coalesce(F.when(F.col(title_col) != "", F.col(title_col)), F.col(source_col))
    return hits.select(by, name.alias("name")).distinct().groupBy(by).agg(F.array_sort(F.collect_list("name")).alias("sources"))
