"""An append-only store of rows by key whose inserts read only what may hold a key.

Rows lie in folders by a hash of the key and by insert (``bucket=../part=..``). Every such piece has a Bloom filter of
its keys, ten bits a key, in a table beside it. An insert deals its keys to their buckets, where they meet the filters of
that bucket; only pieces whose filter says yes are read, and only for the keys it said it of. New keys so cost a look at
the filters, about one in a hundred of them a read. ``compact`` joins the pieces of buckets that many inserts have cut up.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.storage import file_system, materialise

#: Bits and probes a key: one key in about a hundred that is not stored is taken for one that may be.
BITS, PROBES = 10, 7
FILTERS = "bucket int, part string, keys long, bits binary"


def places(hashes: np.ndarray, size: int) -> np.ndarray:
    """[key, probe]: the bits of each key among ``size``, by double hashing."""
    h = hashes.astype(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + np.arange(PROBES, dtype=np.uint64)[None, :] * high[:, None]) % np.uint64(size)).astype(np.int64)


def bloom(hashes: np.ndarray) -> bytes:
    size = max(64, BITS * len(hashes))
    bits = np.zeros(size, dtype=bool)
    bits[places(hashes, size).ravel()] = True
    return size.to_bytes(8, "big") + np.packbits(bits).tobytes()


def may_hold(filter_: bytes, hashes: np.ndarray) -> np.ndarray:
    size = int.from_bytes(filter_[:8], "big")
    bits = np.unpackbits(np.frombuffer(filter_, dtype=np.uint8, offset=8), count=size).astype(bool)
    return bits[places(hashes, size)].all(1)


@dataclass(frozen=True)
class KeyedStore:
    """Rows of ``schema`` (DDL) by the columns of ``key`` at ``path``. One writer at a time."""

    spark: SparkSession
    path: str
    schema: str
    key: tuple[str, ...]
    buckets: int = 64

    def _read(self, name: str, schema: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def rows(self) -> DataFrame:
        """All rows; none where nothing is stored yet."""
        got = self._read("rows", f"{self.schema}, bucket int, part string")
        return self.spark.createDataFrame([], self.schema) if got is None else got.drop("bucket", "part")

    def filters(self) -> DataFrame:
        got = self._read("filters", FILTERS)
        return self.spark.createDataFrame([], FILTERS) if got is None else got

    def _keyed(self, rows: DataFrame) -> DataFrame:
        told = rows.withColumn("__h", F.xxhash64(*self.key))
        return told.withColumn("bucket", F.pmod(F.xxhash64("__h"), F.lit(self.buckets)).cast("int"))

    def suspects(self, keyed: DataFrame) -> DataFrame:
        """(h, bucket, part): for each key hash of ``keyed`` the pieces whose filter says that they may hold it."""

        def probe(a: pa.Table, b: pa.Table) -> pa.Table:
            out: list[tuple[np.ndarray, int, str]] = []
            hashes = np.asarray(a["__h"]) if a.num_rows else np.zeros(0, np.int64)
            for bucket, part, bits in zip(*(b[c].to_pylist() for c in ("bucket", "part", "bits"))):
                if len(hit := hashes[may_hold(bits, hashes)] if len(hashes) else hashes):
                    out.append((hit, bucket, part))
            n = [len(h) for h, _, _ in out]
            return pa.table({"h": pa.array(np.concatenate([h for h, _, _ in out] + [np.zeros(0, np.int64)])), "bucket": pa.array(np.repeat([x[1] for x in out], n).astype(np.int32)), "part": pa.array([x[2] for x, k in zip(out, n) for _ in range(k)], pa.string())})

        keys = keyed.select("bucket", "__h").distinct()
        return keys.groupBy("bucket").cogroup(self.filters().groupBy("bucket")).applyInArrow(probe, "h long, bucket int, part string")

    def missing(self, rows: DataFrame) -> tuple[DataFrame, int]:
        """(the rows whose key is not stored, how many pieces were read to tell); of rows that share a key one stays."""
        fields = [c for c in rows.columns]
        keyed = materialise(self._keyed(rows.dropDuplicates(list(self.key))), "insert")
        suspects = materialise(self.suspects(keyed), "suspects")
        pieces = [(r["bucket"], r["part"]) for r in suspects.select("bucket", "part").distinct().collect()]  # pieces, not keys
        if not pieces:
            return keyed.select(*fields), 0
        paths = [f"{self.path}/rows/bucket={b}/part={p}" for b, p in pieces]
        stored = self.spark.read.schema(f"{self.schema}, bucket int, part string").option("basePath", f"{self.path}/rows").parquet(*paths)
        same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in self.key]
        held = self._keyed(stored.select(*self.key)).join(suspects.select(F.col("h").alias("__h")).distinct(), "__h", "left_semi").select(F.col("__h").alias("__of"), *(F.col(c).alias(f"__{c}") for c in self.key))
        new = keyed.join(held, reduce(and_, same, F.col("__h") == F.col("__of")), "left_anti")
        return new.select(*fields), len(pieces)

    def insert(self, rows: DataFrame) -> tuple[int, int]:
        """Appends the rows whose key is not stored; (how many those were, pieces read). Running it again adds nothing."""
        names = [f.split()[0].strip("`") for f in self.schema.split(",")]
        new, read = self.missing(rows.select(*names))
        return self._write(self._keyed(materialise(new, "new"))), read

    def _write(self, keyed: DataFrame) -> int:
        part = uuid.uuid4().hex

        def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[np.ndarray]] = {}
            for b in batches:
                buckets, hashes = np.asarray(b.column(0)), np.asarray(b.column(1))
                for k in np.unique(buckets):
                    held.setdefault(int(k), []).append(hashes[buckets == k])
            every = [(k, np.concatenate(v)) for k, v in held.items()]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in every], pa.int32()), pa.array([part] * len(every), pa.string()), pa.array([len(h) for _, h in every], pa.int64()), pa.array([bloom(h) for _, h in every], pa.binary())], names=["bucket", "part", "keys", "bits"])

        filters = materialise(keyed.select("bucket", "__h").repartition("bucket").mapInArrow(filtered, FILTERS), "filters")
        told = filters.agg(F.coalesce(F.sum("keys"), F.lit(0))).first()[0]
        if told:  # rows first: a filter without rows would only cost a look, rows without a filter would be missed
            keyed.drop("__h").withColumn("part", F.lit(part)).repartition("bucket").write.mode("append").partitionBy("bucket", "part").parquet(f"{self.path}/rows")
            filters.coalesce(1).write.mode("append").parquet(f"{self.path}/filters")
        return told

    def compact(self, most: int = 8) -> int:
        """Joins the pieces of buckets that have more than ``most``; how many buckets that were.

        The joined rows and the new filters are complete before a piece goes. A run that breaks off leaves pieces that
        hold the same rows twice; ``compact`` again mends that, as it keeps one row of each key.
        """
        filters = materialise(self.filters(), "filters")
        cut = [r["bucket"] for r in filters.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > most).collect()]  # buckets at most
        if not cut:
            return 0
        old = [(r["bucket"], r["part"]) for r in filters.filter(F.col("bucket").isin(cut)).select("bucket", "part").collect()]
        paths = [f"{self.path}/rows/bucket={b}/part={p}" for b, p in old]
        stored = self.spark.read.schema(f"{self.schema}, bucket int, part string").option("basePath", f"{self.path}/rows").parquet(*paths).drop("bucket", "part")
        kept = materialise(filters.filter(~F.col("bucket").isin(cut)), "kept")
        self._write(self._keyed(materialise(stored.dropDuplicates(list(self.key)), "joined")))
        fresh = self.filters().join(filters.select("bucket", "part"), ["bucket", "part"], "left_anti")
        materialise(kept.unionByName(fresh), "filters").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/filters")
        for p in paths:
            fs, at = file_system(self.spark, p)
            fs.delete(at, True)
        return len(cut)


def triple_store(spark: SparkSession, path: str, buckets: int = 64) -> KeyedStore:
    """A store of triples by (subject_key, relation, object_key)."""
    from tessera.sources.sinks import TRIPLES

    return KeyedStore(spark, path, TRIPLES, ("subject_key", "relation", "object_key"), buckets)
