"""Trend annotations and their yearly snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REQUIRED = ("element", "year", "trend_score")


def elements(annotations: DataFrame) -> DataFrame:
    """(element, i): elements numbered from 0 by first appearance (``ord``). The numbering is over distinct elements."""
    from pyspark.sql import Window as W

    firsts = annotations.groupBy("element").agg(F.min("ord").alias("first"))
    return firsts.select("element", (F.row_number().over(W.orderBy("first", "element")) - 1).alias("i"))


def snapshots(annotations: DataFrame) -> DataFrame:
    """(year, element, score) for every year and element: the last row of a year wins, 0 where there is none."""
    missing = set(REQUIRED) - set(annotations.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    last = annotations.groupBy("year", "element").agg(F.max_by("trend_score", "ord").alias("score"))
    grid = annotations.select("year").distinct().crossJoin(annotations.select("element").distinct())  # two dimensions
    return grid.join(last, ["year", "element"], "left").select("year", "element", F.coalesce("score", F.lit(0.0)).alias("score"))


def snapshot_vectors(annotations: DataFrame) -> DataFrame:
    """(year, scores array<double>) in the order of ``elements``."""
    long = snapshots(annotations).join(elements(annotations), "element")
    scores = F.transform(F.sort_array(F.collect_list(F.struct("i", "score"))), lambda s: s["score"])
    return long.groupBy("year").agg(scores.alias("scores"))
