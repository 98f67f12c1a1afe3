"""What the training-data operators share: shared storage, Arrow batch maps, worker caches."""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.storage import file_system, shared_path, shuffle_partitions  # noqa: F401  (the operators import it from here)

#: Batches are cut so that one holds about this many bytes of text (a longer text is a batch of its own).
BATCH_CHARS = 2_000_000

#: Entries a per-worker memo may hold before it is emptied.
MEMO_ENTRIES = 400_000

_resources: dict[str, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to shared storage and reads it back: cuts the lineage, survives lost executors.

    The files go when the session's JVM ends, or by :func:`discard` before.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    fs, at = file_system(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def discard(df: DataFrame) -> None:
    """Removes what :func:`materialise` wrote; call it where no plan reads it any more."""
    fs, at = file_system(df.sparkSession, df.written)
    fs.delete(at, True)


#: Plan nodes under which a row of a file stays one row.
PLAIN = re.compile(r"(?:Project|Filter|SubqueryAlias|Relation|LogicalRelation)\b")


def located(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__file`` and ``__row``, which tell every row apart, repeated rows too.

    Rows that come straight from files have the file's hash and their number in it, at no cost; all others are
    written to shared storage with a number. Rows that have both columns keep them.
    """
    if {"__file", "__row"} <= set(docs.columns):
        return docs
    steps = [re.sub(r"^[\s:+|-]*", "", x) for x in docs._jdf.queryExecution().analyzed().toString().splitlines()]
    if docs.inputFiles() and all(PLAIN.match(x) for x in steps if x) and sum("Relation" in x.split(" ")[0] for x in steps) == 1:
        try:
            return docs.select("*", F.xxhash64("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
        except AnalysisException:  # a format that does not number its rows
            pass
    return materialise(docs.select("*", F.lit(0).cast("long").alias("__file"), F.monotonically_increasing_id().alias("__row")), "rows")


def resource(key: str, build: Callable[[], object]) -> object:
    """Built once per Python worker and kept while its tasks ask for it: a worker holds one compiled thing at a time."""
    if key not in _resources:
        release()
        _resources[key] = build()
    return _resources[key]


def release() -> None:
    """Drops what earlier stages' tasks left in this worker."""
    if _resources:
        _resources.clear()
        gc.collect()


def slices(sizes: list[int], limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive (start, end) ranges of about ``limit`` in sum; each item stays whole."""
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def map_text(df: DataFrame, make: Callable[[], Callable], schema: str, text_at: int, limit: int = BATCH_CHARS) -> DataFrame:
    """Maps rows to rows in Arrow batches of about ``limit`` bytes of text at most.

    ``make()`` runs once per task and returns ``f(columns, texts) -> {name: array}``, where columns are the batch's
    Arrow columns and texts the (null replaced by empty) strings of column ``text_at``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_pylist()
            for a, b in slices(sizes, limit):
                part = batch.slice(a, b - a)
                got = f(part.columns, [t or "" for t in part.column(text_at).to_pylist()])
                yield pa.RecordBatch.from_arrays(list(got.values()), names=list(got))

    return df.mapInArrow(run, schema)


class Memo(dict):
    """A bounded memo: computes missing keys by ``f``. Of two halves the older goes when the newer is full; what is asked for again moves over."""

    def __init__(self, f: Callable, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.f, self.half, self.older = f, entries // 2, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.f(key)
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value
