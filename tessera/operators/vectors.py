"""Vector search over embedding tables: top-k, votes, centroids, prototypes, accuracy.

Query sets are small against the table; exact search over large ones goes through blocks of queries (see ``top_k``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.sources.storage import materialise, shared_path

#: Queries that go to the executors in one block.
QUERY_BLOCK = 4_096
#: Queries and rows whose scores a task holds at once: 4 MB of them.
TILE = 256, 2_048


def smallest_first(ids: np.ndarray) -> np.ndarray:
    """Numbers in the order of the ids, which may be of any kind."""
    return ids if ids.dtype.kind in "iu" else np.unique(ids, return_inverse=True)[1]


class Best:
    """The k rows of greatest score of each of ``n`` queries, ties to the smaller id, from tiles of scores.

    A tile's scores that are under a query's k-th so far are left out by one comparison; only the others are ordered.
    """

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.query, self.row, self.score = np.zeros(0, np.int64), None, np.zeros(0)
        self.least = np.full(n, -np.inf)  # of queries that have k

    def add(self, scores: np.ndarray, ids: np.ndarray, first: int = 0, digits: int | None = None) -> None:
        """``scores`` [query, row] of the queries from ``first`` on; what is minus infinity or no number takes no part.

        ``digits`` rounds the scores, of which only those that may be among the best are rounded at all.
        """
        least = self.least[first : first + len(scores)]
        fresh = np.isneginf(least)
        if scores.shape[1] > self.k and fresh.any():  # what the tile alone puts under its k-th
            some = scores if fresh.all() else scores[fresh]
            if self.k == 1:
                own = np.nan_to_num(np.fmax.reduce(some, axis=1), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
            else:
                with np.errstate(invalid="ignore"):
                    own = np.partition(np.where(np.isnan(some), -np.inf, some), -self.k, axis=1)[:, -self.k]
            least = least.copy()
            least[fresh] = own
        if digits is not None:
            least = least - 10.0**-digits
        at, column = np.nonzero(scores >= least[:, None])
        score = scores[at, column]
        if digits is not None:
            score = np.round(score, digits)
        told = score > -np.inf
        at, column, score = at[told], column[told], score[told]
        if not len(at):
            return
        query, row = at + first, ids[column]
        mine = (self.query >= first) & (self.query < first + len(scores))
        if self.row is not None:
            query, row, score = np.concatenate([self.query[mine], query]), np.concatenate([self.row[mine], row]), np.concatenate([self.score[mine], score])
        order = np.lexsort((smallest_first(row), -score, query))
        query, row, score = query[order], row[order], score[order]
        starts = np.searchsorted(query, np.arange(first, first + len(scores)))
        place = np.arange(len(query)) - starts[query - first]
        full = np.nonzero(place == self.k - 1)[0]
        self.least[query[full]] = score[full]
        keep = place < self.k
        rest = [] if self.row is None else [x[~mine] for x in (self.query, self.row, self.score)]
        self.query, self.row, self.score = (np.concatenate([*([rest[i]] if rest else []), x[keep]]) for i, x in enumerate((query, row, score)))


def same_ids(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``a``, places in ``b``) of equal ids, by order instead of by all pairs."""
    if a.dtype.kind not in "iu" or b.dtype.kind not in "iu":
        return np.nonzero(a[:, None] == b[None, :])
    order = np.argsort(b, kind="stable")
    low, high = (np.searchsorted(b, a, side, sorter=order) for side in ("left", "right"))
    n = high - low
    at = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
    return np.repeat(np.arange(len(a)), n), order[at]


def dense(column: pa.Array) -> np.ndarray:
    """An Arrow column of lists of one length as a matrix; nulls in them are no numbers."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1)


def top_k(queries: DataFrame, rows: DataFrame, k: int, id_col: str, vector_col: str, exclude_self: bool = False, query_cols: tuple[str, ...] = (), row_cols: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, rank, row_id, score, query_cols..., row_cols...): the k rows of greatest cosine, ties to the smaller id.

    Blocks of ``QUERY_BLOCK`` normalised queries go to the executors; each task scores them in tiles of ``TILE`` queries
    and rows, whatever the size of a batch, and keeps the k best of its rows for each query, so at most k rows for each
    query and task meet in the final window. The score is rounded to 4 places after ranking on 10.
    """
    kinds, query_kinds = dict(rows.dtypes), dict(queries.dtypes)
    whole = {"tinyint", "smallint", "int", "bigint"}
    asked = F.col(id_col).cast("long") if query_kinds[id_col] in whole else F.col(id_col)  # narrow ids travel as long
    base = rows.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("row_id"), V.normalized(F.col(vector_col)).alias("v"))
    spark = rows.sparkSession
    it = queries.filter(F.col(vector_col).isNotNull()).select(asked.alias("q"), V.normalized(F.col(vector_col)).alias("v")).toLocalIterator()
    block: list = []
    schema = f"query_id {'long' if query_kinds[id_col] in whole else query_kinds[id_col]}, row_id long, sim double"

    def search(block: list) -> tuple[DataFrame, Broadcast]:
        shared = spark.sparkContext.broadcast((pa.array([r["q"] for r in block]), np.array([r["v"] for r in block], dtype=np.float64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            own, best = np.asarray(ids), Best(len(q), k)
            for b in batches:
                for start in range(0, b.num_rows if len(q) else 0, TILE[1]):
                    part = b.slice(start, TILE[1])
                    row_ids, m = np.asarray(part.column(0)), dense(part.column(1))
                    for first in range(0, len(q), TILE[0]):
                        s = _dots(q[first : first + TILE[0]], m)
                        if exclude_self:
                            s[same_ids(own[first : first + TILE[0]], row_ids)] = -np.inf
                        best.add(s, row_ids, first, 10)
            at, found = best.query, best.row if best.row is not None else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(found), pa.array(best.score)], names=["query_id", "row_id", "sim"])

        return base.mapInArrow(run, schema), shared

    path = None  # further blocks go to storage one after another, so that one block at a time is broadcast; rows are normalised once

    def store(block: list) -> None:
        found, shared = search(block)
        found.write.mode("append").parquet(path)
        shared.destroy()

    for r in it:
        block.append(r)
        if len(block) == QUERY_BLOCK:
            if path is None:
                path, base = shared_path(spark, "hits"), materialise(base, "rows")
            store(block)
            block = []
    if path is None:
        found = search(block)[0]
    else:
        if block:
            store(block)
        found = spark.read.schema(schema).parquet(path)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("sim"), "row_id"))
    out = found.withColumn("rank", rank).filter(F.col("rank") <= k).withColumns({"query_id": F.col("query_id").cast(query_kinds[id_col]), "row_id": F.col("row_id").cast(kinds[id_col])})
    if query_cols:
        out = out.join(queries.select(F.col(id_col).alias("query_id"), *query_cols), "query_id")
    if row_cols:
        out = out.join(rows.select(F.col(id_col).alias("row_id"), *row_cols), "row_id")
    return out.select("query_id", "rank", "row_id", F.round("sim", 4).alias("score"), "sim", *query_cols, *row_cols)


def _dots(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    return q @ m.T if q.size and m.size else np.zeros((len(q), len(m)))


def votes(hits: DataFrame, label: Column, round_first: bool = True, missing: str = "unknown") -> DataFrame:
    """(query_id, label, score, place): summed similarity of each label among a query's hits, best first."""
    weight = F.col("score") if round_first else F.col("sim")
    label = F.coalesce(F.when(label.cast("string") != "", label.cast("string")), F.lit(missing))
    summed = hits.groupBy("query_id", label.alias("label")).agg(F.round(F.sum(weight), 6).alias("raw"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("raw"), "label"))
    return summed.select("query_id", "label", F.round("raw", 3).alias("score"), place.alias("place"))


def centroids(rows: DataFrame, label_col: str, vector_col: str) -> DataFrame:
    """(label, centroid array<double>): normalised mean of each label's normalised vectors. Sums combine before the shuffle."""
    long = rows.select(F.col(label_col).alias("label"), F.posexplode(V.normalized(F.col(vector_col))).alias("i", "x"))
    means = long.groupBy("label", "i").agg(F.avg("x").alias("m"))
    mean = F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"])
    return means.groupBy("label").agg(mean.alias("mean")).select("label", V.normalized(F.col("mean")).alias("centroid"))


def nearest_prototypes(rows: DataFrame, prototypes: DataFrame, id_col: str, vector_col: str, k: int = 3, most: int = 10_000) -> DataFrame:
    """(id, rank, label, score): the k prototypes of greatest cosine; ties by label. ``prototypes(label, centroid)``.

    The prototypes are a small dimension: their number is checked against ``most`` before they are broadcast.
    """
    if prototypes.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} prototypes: use top_k")
    kind = dict(prototypes.dtypes)["label"]
    told = prototypes.agg(F.sort_array(F.collect_list(F.struct("label", "centroid"))).alias("all"))  # one row, checked above
    sims = F.transform("all", lambda p: F.struct((-F.round(V.cosine(F.col("v"), p["centroid"]), 10)).alias("off"), p["label"].alias("label")))
    best = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).crossJoin(F.broadcast(told)).select("id", F.posexplode(F.slice(F.array_sort(sims), 1, k)).alias("at", "b"))
    return best.select("id", (F.col("at") + 1).alias("rank"), F.col("b.label").cast(kind).alias("label"), F.round(-F.col("b.off"), 4).alias("score"))


def top_k_accuracy(voted: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """One row: top{k} share of queries whose label is among the first k voted, n_test. ``truth(query_id, true_label)``."""
    place = truth.join(voted, (truth["query_id"] == voted["query_id"]) & (F.col("true_label") == F.col("label")), "left").select(truth["query_id"], F.coalesce("place", F.lit(1 << 30)).alias("place"))
    return place.agg(*(F.round(F.avg((F.col("place") <= k).cast("int")), 3).alias(f"top{k}") for k in ks), F.count("*").alias("n_test"))


def query_hits(voted: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, hit1) of every query of ``truth(query_id, true_label)``: whether its first voted label is the true one."""
    first = voted.filter("place = 1").select("query_id", "label")
    return truth.join(first, "query_id", "left").select("query_id", F.coalesce((F.col("label") == F.col("true_label")).cast("int"), F.lit(0)).alias("hit1"))


#: Rows below which an accuracy says nothing.
LEAST_ROWS = 5


def accuracy_report(rows: DataFrame, held_out: Column, id_col: str, label_col: str, vector_col: str, neighbours: int = 10, split_by: str = "row", iterations: int | None = None) -> DataFrame:
    """One row: top1, top3, top5, n_test, n_labels, random_top1, split_by (and lo, hi): labels of held-out rows voted by the others.

    ``held_out`` is a boolean column of ``rows``; ValueError for fewer than ``LEAST_ROWS`` rows.
    """
    from tessera.operators.evaluation import bootstrap_ci

    n, labels = rows.agg(F.count("*"), F.countDistinct(F.col(label_col))).first()
    if n < LEAST_ROWS:
        raise ValueError(f"{n} rows are too few to evaluate")
    held, known = rows.filter(held_out), rows.filter(~held_out)
    truth = held.select(F.col(id_col).alias("query_id"), F.col(label_col).cast("string").alias("true_label"))
    voted = votes(top_k(held, known, neighbours, id_col, vector_col, row_cols=(label_col,)), F.col(label_col), round_first=False)
    out = top_k_accuracy(voted, truth).withColumns({"n_labels": F.lit(labels).cast("long"), "random_top1": F.round(F.lit(1.0) / F.lit(labels), 3), "split_by": F.lit(split_by)})
    return out.crossJoin(bootstrap_ci(query_hits(voted, truth), F.col("hit1") == 1, iterations)) if iterations else out  # two single rows
