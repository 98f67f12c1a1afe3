"""Corpus pipeline: language, lines, near-duplicates, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet and read again as the
next one's ``docs``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, langid, line_dedup, minhash
from tessera.llm.common import located, materialise, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told (no text, no letters) go; the others get the language found as ``lang``.

    Rows with a null doc_id are judged like all others.
    """
    model = langid.fit(docs)
    kept = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = langid.identify(docs, model, keep=("text", *kept)).filter(F.col("lang_pred") != langid.UNDETERMINED)
    return found.select(*(F.col("lang_pred").alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns))


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every line after the first of its class goes; documents left without a line go too. n_chars follows the text.

    Rows are told apart by their place, so rows without an id and rows that share one lose repeated lines like all others.
    """
    left = line_dedup.drop_repeated_lines(docs).filter(F.coalesce(F.trim(F.translate("text", "\n", " ")), F.lit("")) != "")
    return left.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def deduplicate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8 or more.

    It is the one of the smallest doc_id (rows without one last, then the order of the rows). Groups are of rows, so
    of repeated rows one stays, and rows that share an id are judged by their own texts.
    """
    rows = located(docs)
    numbered = materialise(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "__file", "__row"), "numbered")
    found = minhash.near_duplicates(numbered, id_col="row").filter(F.col("component_id").isNotNull()).select(F.col("doc_id").alias("row"), "component_id")
    places = numbered.select("row", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "__file", "__row").alias("place")).join(found, "row")
    # a component of one has no row but its own: the least of a group of copies is combined before the shuffle
    firsts = places.groupBy("component_id").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1").select("component_id", "first")
    gone = places.join(firsts, "component_id").filter("place.row <> first.row").select(F.col("place.__file").alias("__gf"), F.col("place.__row").alias("__gr"))
    left = rows.join(gone, (F.col("__file") == F.col("__gf")) & (F.col("__row") == F.col("__gr")), "left_anti")
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item, with up to the budget of edits, go; each row is judged by its own text."""
    kept = tuple(c for c in docs.columns if c != "doc_id")
    found = decontam.contaminated(docs, table(spark, sf_dir, "benchmark"), keep=kept).filter(F.size("hits") == 0)
    return found.select(*(F.col(f"`{c}`") for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): the encoding of every document left, decoded again and told by its digest."""
    coded = bpe.bpe_encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", deduplicate_lines),
    ("MinHash near-dedup", deduplicate_documents),
    ("benchmark decontamination", decontaminate),
    ("BPE encoding and decoding", encode),
]

#: The stages' automata, classes and models are beyond SQL; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
