"""Approximate cosine search by coarse cells: an index that is built once, stored, probed by key and re-ranked exactly.

The cells' centroids and the number of cells to probe are fitted on a bounded sample; every row is indexed. A query
meets the rows of its nearest cells only, and there its cosines are exact. How many cells that takes depends on the
data: the fit raises the number until the sample's own queries find the share of their true neighbours that is asked
for. Cells are dealt into blocks of bounded size, queries of a cell into shares, so a cell with a third of all rows is
many groups of one size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.sources.storage import materialise

#: Rows and queries of a group that one task scores at once.
BLOCK_ROWS, BLOCK_QUERIES = 2048, 1024


@dataclass(frozen=True)
class CellIndex:
    """A stored index: rows(cell, row_id, v) laid out by cell, cells(cell, centroid, n), the cells to probe and the sample's recall with them."""

    spark: SparkSession
    path: str
    probe: int
    recall: float

    def rows(self) -> DataFrame:
        return self.spark.read.schema("cell int, row_id long, v array<double>").parquet(f"{self.path}/rows")

    def cells(self) -> DataFrame:
        """One row for each cell that has rows: as many as the fit was asked for at most."""
        return self.spark.read.schema("cell int, centroid array<double>, n long").parquet(f"{self.path}/cells")


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row_id, v): normalised vectors; rows without an id or with a null, empty or non-finite vector take no part."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return rows.filter(F.col(id_col).isNotNull() & (F.size(x) > 0) & finite).select(F.col(id_col).cast("long").alias("row_id"), V.normalized(x).alias("v"))


def spherical(points: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Centroids of length one; they start at rows evenly spaced in the (hashed) order of the sample."""
    at = points[np.linspace(0, len(points) - 1, cells).astype(int)]
    for _ in range(rounds):
        of = (points @ at.T).argmax(1)
        sums = np.zeros_like(at)
        np.add.at(sums, of, points)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        at = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), at)
    return at


def probes_needed(points: np.ndarray, centroids: np.ndarray, k: int, target: float, most: int = 200) -> tuple[int, float]:
    """The least number of cells with which the first ``most`` points find ``target`` of their k nearest others, and that share."""
    q = points[:most]
    near = q @ points.T
    near[np.arange(len(q)), np.arange(len(q))] = -np.inf
    truth = np.argsort(-near, axis=1, kind="stable")[:, : min(k, len(points) - 1)]
    if not truth.size:
        return 1, 1.0
    of = (points @ centroids.T).argmax(1)
    place = np.argsort(np.argsort(-(q @ centroids.T), axis=1, kind="stable"), axis=1, kind="stable")  # of each cell for each query
    needed = np.take_along_axis(place, of[truth], axis=1) + 1
    found = np.array([(needed <= p).mean() for p in range(1, len(centroids) + 1)])
    probe = int(np.argmax(found >= target)) + 1
    return probe, float(found[probe - 1])


def build_index(rows: DataFrame, path: str, id_col: str = "vec_id", vector_col: str = "embedding", cells: int = 256, sample: int = 20_000, target: float = 0.95, k: int = 10) -> CellIndex:
    """Fits on ``sample`` rows (the first by hash of their id, 8 for each cell at least), indexes every row, writes to ``path``.

    ``target`` is the share of the sample's true ``k`` neighbours that the number of probed cells must reach. All
    vectors must be of one length. An empty table gives an empty index.
    """
    spark = rows.sparkSession
    base = usable(rows, id_col, vector_col)
    drawn = base.orderBy(F.xxhash64("row_id"), "row_id").limit(sample).select("v").toArrow()["v"]
    points = np.array(drawn.to_pylist(), dtype=np.float64) if len(drawn) else np.zeros((0, 1))
    centroids = spherical(points, max(1, min(cells, len(points) // 8))) if len(points) else points
    probe, recall = probes_needed(points, centroids, k, target) if len(points) else (1, 1.0)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1)
            of = (np.asarray(v.flatten()).reshape(b.num_rows, -1) @ centroids.T).argmax(1) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)), *b.columns], names=["cell", "row_id", "v"])

    told = base.mapInArrow(assign, "cell int, row_id long, v array<double>").withColumn("at", F.xxhash64("row_id"))
    told.repartitionByRange("cell", "at").sortWithinPartitions("cell", "at").drop("at").write.mode("overwrite").parquet(f"{path}/rows")
    index = CellIndex(spark, path, probe, recall)
    middle = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
    middle.join(index.rows().groupBy("cell").agg(F.count("*").alias("n")), "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    spark.createDataFrame([(probe, recall)], "probe int, recall double").coalesce(1).write.mode("overwrite").parquet(f"{path}/fit")
    return index


def open_index(spark: SparkSession, path: str) -> CellIndex:
    """A stored index; an error where there is none."""
    fit = spark.read.schema("probe int, recall double").parquet(f"{path}/fit").first()
    return CellIndex(spark, path, fit["probe"], fit["recall"])


def probed(index: CellIndex, queries: DataFrame, id_col: str, vector_col: str, probe: int | None = None) -> DataFrame:
    """(query_id, v, cell, n): the nearest cells of every query that have rows, with their sizes."""
    cells = [(r["cell"], r["centroid"], r["n"]) for r in index.cells().orderBy("cell").toLocalIterator()]  # bounded by the fit
    take = min(probe or index.probe, len(cells))
    numbers, centroids, sizes = np.array([c[0] for c in cells], np.int32), np.array([c[1] for c in cells]), np.array([c[2] for c in cells], np.int64)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and take:
                q = np.asarray(b.column(1).flatten()).reshape(b.num_rows, -1)
                first = np.argsort(-(q @ centroids.T), axis=1, kind="stable")[:, :take].ravel()
                at = pa.array(np.repeat(np.arange(b.num_rows), take))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(numbers[first]), pa.array(sizes[first])], names=["query_id", "v", "cell", "n"])

    return usable(queries, id_col, vector_col).mapInArrow(near, "query_id long, v array<double>, cell int, n long")


def candidates(index: CellIndex, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", probe: int | None = None) -> DataFrame:
    """(query_id, candidates): how many rows a query's cells hold, which are those it is scored against."""
    return probed(index, queries, id_col, vector_col, probe).groupBy("query_id").agg(F.sum("n").alias("candidates"))


def search(index: CellIndex, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", probe: int | None = None, exclude_self: bool = False) -> DataFrame:
    """(query_id, rank, row_id, score, sim): of the rows in a query's cells the k of greatest cosine, ties to the smaller id.

    Scores and ties are those of ``vectors.top_k``; only rows of other cells can be missing. Queries are told apart by
    their id.
    """
    asked = materialise(probed(index, queries, id_col, vector_col, probe), "probes")
    sides = asked.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("shares"), F.ceil(F.first("n") / BLOCK_ROWS).cast("int").alias("blocks"))
    sides = F.broadcast(sides)  # a row for each cell at most
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = asked.join(sides, "cell").select("cell", deal("query_id", "shares").alias("share"), each("blocks").alias("block"), "query_id", "v")
    right = index.rows().join(sides, "cell").select("cell", each("shares").alias("share"), deal("row_id", "blocks").alias("block"), "row_id", "v")

    def scored(a: pa.Table, b: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if a.num_rows and b.num_rows:
            q, m = (np.asarray(t["v"].combine_chunks().flatten()).reshape(t.num_rows, -1) for t in (a, b))
            asks, ids = np.asarray(a["query_id"]), np.asarray(b["row_id"])
            s = np.round(q @ m.T, 10)
            if exclude_self:
                s[asks[:, None] == ids[None, :]] = -np.inf
            order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
            s, ids = np.take_along_axis(s, order, 1), ids[order]
            at, col = np.nonzero(s > -np.inf)
            out = [asks[at], ids[at, col], s[at, col]]
        return pa.table([pa.array(x) for x in out], names=["query_id", "row_id", "sim"])

    keys = ("cell", "share", "block")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scored, "query_id long, row_id long, sim double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("sim"), "row_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "row_id", F.round("sim", 4).alias("score"), "sim")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (queries, wanted, recall): the share of ``exact(query_id, row_id)`` that ``found`` holds."""
    got = found.select("query_id", "row_id", F.lit(1).alias("__got"))
    return exact.join(got, ["query_id", "row_id"], "left").agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("wanted"), F.avg(F.coalesce("__got", F.lit(0))).alias("recall"))
