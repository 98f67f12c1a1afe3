"""Rank fusion and two-stage ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def reciprocal_rank_fusion(lists: DataFrame, k: int = 60, top_k: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., item, score, place) from (by..., list_id, rank from 1, item): sum of 1 / (k + rank), ties by first appearance."""
    if k < 0:
        raise ValueError("k must not be negative")
    fused = lists.groupBy(*by, "item").agg(F.round(F.sum(1 / (k + F.col("rank"))), 10).alias("score"), F.min(F.struct("list_id", "rank")).alias("first"))
    over = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    out = fused.withColumn("place", F.row_number().over(over.orderBy(F.desc("score"), "first.list_id", "first.rank")))
    if top_k is not None:
        out = out.filter(F.col("place") <= top_k)
    return out.select(*by, "item", "score", "place")


def pool_then_rerank(scored: DataFrame, k: int, by: tuple[str, ...] = ("query_id",), factor: int = 4, rrf_k: int = 60) -> DataFrame:
    """(by..., item, score, place): the first ``factor * k`` by ``first``, ranked again by ``second``, both ranks fused.

    ``scored`` holds (by..., item, first, second).
    """
    ranked = scored.withColumn("r1", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("first"), "item"))).filter(F.col("r1") <= max(factor * k, k))
    ranked = ranked.withColumn("r2", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("second"), "r1")))
    lists = ranked.select(*by, "item", F.inline(F.array(F.struct(F.lit(0).alias("list_id"), F.col("r1").alias("rank")), F.struct(F.lit(1).alias("list_id"), F.col("r2").alias("rank")))))
    return reciprocal_rank_fusion(lists, rrf_k, k, by)
