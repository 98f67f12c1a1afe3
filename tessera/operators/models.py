"""Losses, heads and forward passes as expressions; training of small heads; language models behind a protocol."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.functions import vectors as V
from tessera.sources.storage import materialise


def pair_metrics(pairs: DataFrame, winner: str, loser: str) -> DataFrame:
    """One row (loss, accuracy) of scored pairs: Bradley-Terry loss and share of winners ahead."""
    d = F.col(winner) - F.col(loser)
    return pairs.agg(F.avg(F.log1p(F.exp(-d))).alias("loss"), F.avg((d > 0).cast("int")).alias("accuracy"))


#: Rows that may meet in one batch: each meets each.
BATCH_ROWS = 8192


def _one_batch(rows: DataFrame, batch: Column | None) -> None:
    if batch is None and rows.limit(BATCH_ROWS + 1).count() > BATCH_ROWS:
        raise ValueError(f"more than {BATCH_ROWS} rows: deal them into batches")


def info_nce(pairs: DataFrame, scale: float = 100.0, batch: Column | None = None) -> DataFrame:
    """One row (loss): symmetric InfoNCE of (id, image, text) vectors, averaged over batches; the pairs of a batch meet.

    Without ``batch`` all rows are one batch, as a training step's are; ValueError if they are more than ``BATCH_ROWS``.
    """
    _one_batch(pairs, batch)
    by = F.lit(0) if batch is None else batch
    a = pairs.select(by.alias("batch"), F.col("id").alias("i"), V.normalized(F.col("image")).alias("x"))
    b = pairs.select(by.alias("batch"), F.col("id").alias("j"), V.normalized(F.col("text")).alias("y"))
    logit = a.join(b, "batch").select("batch", "i", "j", (scale * V.dot(F.col("x"), F.col("y"))).alias("s"))

    def one_way(side: str) -> DataFrame:
        top = F.max("s").over(W.partitionBy("batch", side))
        lse = logit.withColumn("top", top).groupBy("batch", side).agg((F.max("top") + F.log(F.sum(F.exp(F.col("s") - F.col("top"))))).alias("lse"), F.max(F.when(F.col("i") == F.col("j"), F.col("s"))).alias("own"))
        return lse.groupBy("batch").agg(F.avg(F.col("lse") - F.col("own")).alias(side))

    return one_way("i").join(one_way("j"), "batch").agg(F.avg((F.col("i") + F.col("j")) / 2).alias("loss"))


def supervised_contrastive(rows: DataFrame, weights: DataFrame, temperature: float = 0.1, batch: Column | None = None) -> DataFrame:
    """One row (loss): weighted contrastive loss of (id, label, v), averaged over batches; ``weights(a, b, weight)`` between labels.

    A row's own pair is masked; its weights are scaled to sum to one; rows without weight are left out. Without ``batch``
    all rows are one, ``BATCH_ROWS`` at most.
    """
    _one_batch(rows, batch)
    by = F.lit(0) if batch is None else batch
    a = rows.select(by.alias("batch"), F.col("id").alias("i"), F.col("label").alias("a"), V.normalized(F.col("v")).alias("x"))
    b = rows.select(by.alias("batch"), F.col("id").alias("j"), F.col("label").alias("b"), V.normalized(F.col("v")).alias("y"))
    s = a.join(b, "batch").filter("i <> j").select("batch", "i", "j", "a", "b", (V.dot(F.col("x"), F.col("y")) / temperature).alias("s"))
    s = s.withColumn("top", F.max("s").over(W.partitionBy("batch", "i")))
    s = s.withColumn("lse", F.col("top") + F.log(F.sum(F.exp(F.col("s") - F.col("top"))).over(W.partitionBy("batch", "i"))))
    w = s.join(weights, ["a", "b"]).groupBy("batch", "i").agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * (F.col("s") - F.col("lse"))).alias("t"))
    return w.filter("w > 0").groupBy("batch").agg(F.avg(-F.col("t") / F.col("w")).alias("loss")).agg(F.avg("loss").alias("loss"))


def paired(pairs: DataFrame, items: DataFrame, id_col: str, *columns: str) -> DataFrame:
    """``pairs(winner, loser)`` with the items' columns as ``winner_{c}`` and ``loser_{c}``; pairs of unknown items go."""
    for side in ("winner", "loser"):
        pairs = pairs.join(items.select(F.col(id_col).alias(side), *(F.col(c).alias(f"{side}_{c}") for c in columns)), side)
    return pairs


def recurrent_scores(spread: np.ndarray, params: dict[str, np.ndarray]) -> np.ndarray:
    """Scores of nodes from their neighbourhoods' features [time, node, feature]: GRU and attention over time, logistic head."""
    logistic: Callable = lambda x: 1 / (1 + np.exp(-x))
    p, states = params, []
    h = np.zeros((spread.shape[1], p["uz"].shape[0]))
    for x in spread:
        x = np.maximum(x @ p["wg"] + p["bg"], 0)
        z = logistic(x @ p["wz"] + h @ p["uz"] + p["bz"])
        r = logistic(x @ p["wr"] + h @ p["ur"] + p["br"])
        h = (1 - z) * np.tanh(x @ p["wh"] + (r * h) @ p["uh"] + p["bh"]) + z * h
        states.append(h)
    s = np.stack(states, axis=1)  # node, time, hidden
    q, k, v = s @ p["wq"], s @ p["wk"], s @ p["wv"]
    e = q[:, -1:] @ k.transpose(0, 2, 1) / np.sqrt(q.shape[-1])  # the last season looks back
    e = np.exp(e - e.max(-1, keepdims=True))
    out = (e / e.sum(-1, keepdims=True) @ v)[:, 0]
    return logistic(np.maximum(out @ p["w1"] + p["b1"], 0) @ p["w2"] + p["b2"]).ravel()


def temporal_forward(adjacency: np.ndarray, snapshots: np.ndarray, params: dict[str, np.ndarray]) -> np.ndarray:
    """Trend scores of a small temporal graph network held in memory: graph convolution, GRU and attention over time, logistic head.

    ``snapshots`` [time, node, feature]; params hold wg, bg (convolution), wz uz bz, wr ur br, wh uh bh (GRU),
    wq wk wv (attention), w1 b1 w2 b2 (head).
    """
    if snapshots.ndim != 3 or adjacency.shape != (snapshots.shape[1],) * 2:
        raise ValueError(f"shapes do not fit: {adjacency.shape}, {snapshots.shape}")
    a = adjacency + np.eye(len(adjacency))
    d = 1 / np.sqrt(a.sum(1))
    return recurrent_scores(np.stack([a * d[:, None] * d[None, :] @ x for x in snapshots]), params)


def temporal_scores(snapshots: DataFrame, links: DataFrame, params: dict[str, np.ndarray]) -> DataFrame:
    """(node, score) of ``temporal_forward``, over tables: ``snapshots(t, node, x array<double>)``, ``links(src, dst)`` directed.

    Each season's features spread over the links by joins and sums; a node's seasons then meet in one row, ordered, and
    recurrence and attention run over many nodes' rows at once. Nodes, edges and seasons are dealt out; the weights
    alone go to every task. A node without a row in a season has features of zero there; nodes of links alone are
    nodes, too. Of several rows of a node and season the greatest features count. Null nodes, seasons and features are
    left out; no snapshots, no scores. ValueError if features are not as long as the first weights ask.
    """
    told = snapshots.filter("t IS NOT NULL AND node IS NOT NULL AND x IS NOT NULL").groupBy("t", "node").agg(F.max("x").alias("x"))
    told = materialise(told, "snapshots")
    width = len(params["wg"])
    wrong = told.filter(F.size("x") != width).select(F.size("x").alias("n")).first()
    if wrong:
        raise ValueError(f"{wrong['n']} features where the weights take {width}")
    pairs = links.filter("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct()
    nodes = told.select("node").unionByName(pairs.select(F.col("src").alias("node"))).unionByName(pairs.select(F.col("dst").alias("node"))).distinct()
    seasons = told.select("t").distinct()
    loops = pairs.filter("src <> dst").unionByName(nodes.select(F.col("node").alias("src"), F.col("node").alias("dst")))
    degree = loops.groupBy(F.col("dst").alias("of")).agg(F.count("*").alias("d"))
    weighed = loops.join(degree.select(F.col("of").alias("src"), F.col("d").alias("ds")), "src").join(degree.select(F.col("of").alias("dst"), F.col("d").alias("dd")), "dst")
    weighed = weighed.select("src", "dst", (1 / F.sqrt(F.col("ds") * F.col("dd"))).alias("w"))
    spread = told.join(weighed, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node"), "t").agg(*(F.sum(F.col("w") * F.element_at("x", i + 1)).alias(f"x{i}") for i in range(width)))
    spread = spread.select("node", F.struct("t", F.array(*(f"x{i}" for i in range(width))).alias("x")).alias("s"))
    by_node = nodes.join(spread, "node", "left").groupBy("node").agg(F.sort_array(F.collect_list("s")).alias("s"))  # as long as there are seasons
    order = F.broadcast(seasons.agg(F.sort_array(F.collect_list("t")).alias("ts")))  # a row of one entry a season
    zero = F.array_repeat(F.lit(0.0), width)
    rows = by_node.withColumn("s", F.map_from_entries("s")).crossJoin(order).filter(F.size("ts") > 0).select("node", F.transform("ts", lambda t: F.coalesce(F.element_at("s", t), zero)).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column(1).flatten().flatten()).reshape(b.num_rows, -1, width).transpose(1, 0, 2)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(recurrent_scores(x, params))], names=["node", "score"])

    return rows.mapInArrow(run, f"node {dict(snapshots.dtypes)['node']}, score double")


class LanguageModel(Protocol):
    """What a capability needs of a model; must be picklable, for it runs on the executors."""

    def complete(self, prompt: str, system: str = "", max_tokens: int = 512) -> str: ...


class EchoModel:
    """Deterministic stand-in: replies by the first rule whose key the prompt holds, else with ``default``."""

    def __init__(self, rules: dict[str, str] | None = None, default: str = ""):
        self.rules, self.default = rules or {}, default

    def complete(self, prompt: str, system: str = "", max_tokens: int = 512) -> str:
        return next((v for k, v in self.rules.items() if k in prompt), self.default)


def chatted(rows: DataFrame, messages_col: str, model: LanguageModel, out_col: str = "reply") -> DataFrame:
    """``rows`` with the model's reply to ``messages_col`` (array<struct<role, content>>); the messages go.

    The system's messages are the model's system text, all others its prompt.
    """
    of = lambda system: F.array_join(F.transform(F.filter(messages_col, lambda m: (m["role"] == "system") if system else (m["role"] != "system")), lambda m: m["content"]), "\n\n")
    kept = [c for c in rows.columns if c != messages_col]
    asked = rows.select(*kept, of(False).alias("__prompt"), of(True).alias("__system"))
    return completed(asked, "__prompt", model, out_col, system_col="__system").drop("__prompt", "__system")


def completed(rows: DataFrame, prompt_col: str, model: LanguageModel, out_col: str = "reply", system: str = "", system_col: str | None = None) -> DataFrame:
    """``rows`` with the model's reply; a failing call gives an empty reply, as the callers degrade."""
    schema = StructType([*rows.schema.fields, StructField(out_col, StringType())])
    at = rows.columns.index(prompt_col)
    system_at = rows.columns.index(system_col) if system_col else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            replies = []
            systems = [system] * b.num_rows if system_at is None else b.column(system_at).to_pylist()
            for p, s in zip(b.column(at).to_pylist(), systems):
                try:
                    replies.append(model.complete(p or "", s or ""))
                except Exception:  # noqa: BLE001  any failure of an outside service
                    replies.append("")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(replies, pa.string())], names=[*b.schema.names, out_col])

    return rows.mapInArrow(run, schema)
