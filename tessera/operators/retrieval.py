"""Chunk stores and retrieval: embed, store, filtered exact cosine top-n, text stand-in encoder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import ingest
from tessera.operators.vectors import top_k

#: What an encoder is: a column of texts to a column of vectors.
Encoder = Callable[[Column], Column]


def hashing_encoder(dim: int = 64) -> Encoder:
    """Deterministic stand-in for a trained text encoder: signed counts of hashed words, all in expressions."""

    def encode(text: Column) -> Column:
        words = F.filter(F.split(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+", " ")), " "), lambda w: w != "")
        hashed = F.transform(words, lambda w: F.xxhash64(w))
        sign = lambda h: F.when(F.shiftrightunsigned(h, 40) % 2 == 0, 1.0).otherwise(-1.0)
        zero = F.array_repeat(F.lit(0.0), dim)
        return F.aggregate(hashed, zero, lambda acc, h: F.transform(acc, lambda x, i: F.when(i == F.pmod(h, F.lit(dim)).cast("int"), x + sign(h)).otherwise(x)))

    return encode


def build_store(docs: DataFrame, encoder: Encoder, order: str = "ord") -> DataFrame:
    """(id, source, i, chunk, embedding, ...) of cleaned documents: recursive chunks, last write of an id wins."""
    stored = ingest.upsert(ingest.chunks(ingest.clean_documents(docs)), order)
    return stored.withColumn("embedding", encoder(F.col("chunk")))


def retrieve(store: DataFrame, queries: DataFrame, encoder: Encoder, n: int = 5, where: Column | None = None) -> DataFrame:
    """(query_id, rank, document, source, distance) of (id, query): cosine distance; the filter runs before the search."""
    rows = (store.filter(where) if where is not None else store).select("chunk", "source", "embedding", F.xxhash64("id").alias("row"))
    asked = queries.select(F.col("id").alias("row"), encoder(F.col("query")).alias("embedding"))
    found = top_k(asked, rows, n, "row", "embedding", row_cols=("chunk", "source"))
    return found.select("query_id", "rank", F.col("chunk").alias("document"), "source", F.round(1 - F.col("sim"), 4).alias("distance"))
