"""Writers: upserts, idempotent inserts, training splits, memory, vector tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.operators import ingest
from tessera.operators import triples as T
from tessera.sources.storage import materialise


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


TRIPLES = "ord long, subject string, relation string, object string, subject_type string, object_type string, source string, subject_key string, object_key string"
#: Folders that an upsert store is dealt into by a hash of the key.
BUCKETS = 64


def open_triples(spark: SparkSession, path: str) -> DataFrame:
    """The stored triples; an empty table where nothing is stored yet."""
    got = _stored(spark, path)
    return spark.createDataFrame([], TRIPLES) if got is None else got


def append_triples(triples: DataFrame, path: str) -> int:
    """Appends what is not stored yet; returns how many rows that were. Running it again adds nothing.

    One writer at a time: two that run at once may both add a triple.
    """
    stored = _stored(triples.sparkSession, path)
    new = T.first_per_key(triples) if stored is None else T.insert_new(stored, triples)
    told = Observation()
    new.observe(told, F.count("*").alias("n")).write.mode("append").parquet(path)
    return told.get["n"]


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an upsert store; FileNotFoundError if there is none."""
    got = _stored(spark, path)
    if got is None:
        raise FileNotFoundError(path)
    return got.drop("bucket")


def upsert_rows(new: DataFrame, path: str, key: str = "id") -> None:
    """Replaces rows by key and adds the others.

    Rows lie in folders by a hash of the key; only the folders that ``new`` has keys of are read and written. What
    goes in is complete in shared storage before any folder is replaced.
    """
    spark = new.sparkSession
    stored = _stored(spark, path)
    new = materialise(new.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")), "upsert")
    if stored is None:
        merged = new
    else:
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
        old = stored.filter(F.col("bucket").isin(touched))
        merged = materialise(old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True), "merged")
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def add_annotations(annotations: DataFrame, path: str, encoder: Callable[[Column], Column]) -> None:
    """Experts' annotations (element, season, year, context, ...) as passages of the chunk store at ``path``."""
    text = ingest.annotation_text(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("element", "season", "year", "context")))
    rows = annotations.select(text.alias("chunk"), F.lit("expert").alias("source"), F.lit(0).alias("i"))
    rows = rows.withColumn("id", F.concat(F.lit("expert_"), F.md5(F.col("chunk").cast("binary")))).dropDuplicates(["id"])
    upsert_rows(rows.withColumn("embedding", encoder(F.col("chunk"))), path)


def write_head(spark: SparkSession, path: str, **arrays: np.ndarray) -> None:
    """A model's arrays as a table (name, shape, x)."""
    rows = [(k, [int(n) for n in np.shape(a)], [float(x) for x in np.ravel(a)]) for k, a in arrays.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, x array<double>").write.mode("overwrite").parquet(path)


def read_head(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    got = _stored(spark, path)
    if got is None:
        raise FileNotFoundError(f"{path}: train the head first")
    return {r["name"]: np.array(r["x"]).reshape(r["shape"]) for r in got.collect()}  # a model's few arrays


def write_split(examples: DataFrame, path: str) -> None:
    """``train`` and ``valid`` JSON lines of examples with ``part``: one pass, one folder for each."""
    examples.write.mode("overwrite").partitionBy("part").json(path)


def stored_json(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The rows of JSON lines at ``path``; None where nothing is stored yet."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def append_captions(captions: DataFrame, path: str) -> None:
    captions.filter(F.coalesce(F.trim("caption"), F.lit("")) != "").write.mode("append").json(path)


def write_vectors(rows: DataFrame, path: str) -> None:
    """An index: normalised vectors with their metadata columns."""
    from tessera.functions.vectors import normalized

    rows.withColumn("embedding", normalized(F.col("embedding")).cast("array<float>")).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    got = _stored(spark, path)
    if got is None:
        raise FileNotFoundError(path)
    return got


class Memory:
    """A small namespaced key-value store in one Parquet table; the last value of a key counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def remember(self, namespace: str, **values: object) -> None:
        stored = _stored(self.spark, self.path)
        at = (stored.agg(F.max("ord")).first()[0] or 0) + 1 if stored is not None else 0
        rows = [(at + i, namespace, k, str(v)) for i, (k, v) in enumerate(values.items())]
        if rows:
            self.spark.createDataFrame(rows, "ord long, namespace string, key string, value string").write.mode("append").parquet(self.path)

    def update(self, namespace: str, values: dict[str, object]) -> None:
        self.remember(namespace, **values)

    def snapshot(self, namespace: str) -> dict[str, str]:
        stored = _stored(self.spark, self.path)
        if stored is None:
            return {}
        last = stored.filter(F.col("namespace") == namespace).groupBy("key").agg(F.max_by("value", "ord").alias("value"))
        return {r["key"]: r["value"] for r in last.collect()}  # a session's keys

    def recall(self, namespace: str, key: str, default: str | None = None) -> str | None:
        return self.snapshot(namespace).get(key, default)
