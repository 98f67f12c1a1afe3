"""Token ids in Parquet: list columns, selective reads of ids or of metadata alone.

Layout of a store: ``tokens/`` holds rows (part int, at long, doc_id, n_tokens int, ids array<int>) in ascending
doc_id order, one file per part, parts in that order too; ``at`` counts the ids of the part's rows before; ``parts/`` holds (part, start): the ids of all parts before it. Ids and
counts are delta or dictionary encoded (Parquet format v2), row groups and pages have stated sizes, and Parquet's
page indexes let a reader skip to the rows of a doc_id and read n_tokens without the ids.
"""

from __future__ import annotations

import json
import os
import zlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.bpe import byte_symbols, lowered, read_spec, split_pattern
from tessera.llm.common import Memo, map_text, resource


#: Chunks a worker's memo holds at most.
MEMO_ENTRIES = 1_000_000


class LibraryEncoder:
    """The tokenizers library behind a bounded memo of blank-free chunks.

    The tokenizer drops white space and no token, special tokens included, has any; so an encoding is that of its
    chunks between blanks and line feeds, and the library sees each chunk once. A chunk of lower-case Latin-1
    characters is not changed by the normaliser any more: it is split by the tokenizer's own pattern, and the parts
    go to the library's model. All other chunks, and those that might spell a special token, go through the whole
    tokenizer.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenize = self.tokenizer.model.tokenize
        self.find, self.symbols = split_pattern(json.loads(spec)), byte_symbols()
        self.hints = {t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.memo = Memo(self._chunk, MEMO_ENTRIES)

    def _whole(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if not (word.isascii() and word.isprintable()):  # else its bytes stand for themselves
            word = "".join(map(self.symbols.__getitem__, word.encode()))
        return b"".join([t.id.to_bytes(4, "little") for t in self.tokenize(word)])

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii():
            if chunk.isalpha() and chunk.islower():
                return self._word(chunk)
            fixed = chunk == chunk.lower()
        else:
            fixed = max(chunk) < "\u0100" and chunk == chunk.lower()
        if not fixed:
            return self._whole(chunk)
        for h in self.hints:
            if h in chunk:
                return self._whole(chunk)
        memo, parts = self.memo, []
        for word in self.find(chunk):
            ids = memo.get(word) or memo.older.get(word)
            if ids is None:
                ids = self._word(word)
                if word != chunk:
                    memo[word] = ids
            parts.append(ids)
        return b"".join(parts)

    def encode(self, texts: list[str], end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin (with the end of the last)."""
        end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
        ids = self.memo.__getitem__  # encodes what it does not have
        out = [b"".join(map(ids, lowered(t, self.hints).replace("\n", " ").split(" "))) + end for t in texts]
        ends = np.cumsum([0, *map(len, out)], dtype=np.int64) // 4
        return np.frombuffer(b"".join(out), dtype="<u4"), ends


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", row_group_mb: int = 64, page_kb: int = 256, parts: int | None = None) -> None:
    """Writes the ids of every whole text, ``end_id`` appended, in ascending doc_id order.

    Null and empty texts hold the end id alone. Null doc_ids come first; equal doc_ids are ordered by text and each
    keeps its row. An empty table writes an empty store. Columns other than the two are not read. ``docs`` is dealt
    by ranges of (doc_id, text hash), so that no key can fill one part.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(read_spec(tokenizer))
    kind = docs.schema[id_col].dataType.simpleString()
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    rows = rows.select(F.spark_partition_id().alias("part"), "doc_id", "text")

    def make():
        encoder = resource(f"library:{hash(spec.value)}", lambda: LibraryEncoder(spec.value))
        done = 0  # ids of this part so far: batches come in order

        def f(columns, texts):
            nonlocal done
            flat, ends = encoder.encode(texts, end_id)
            at, done = ends[:-1] + done, done + int(ends[-1])
            return {"part": columns[0], "at": pa.array(at), "doc_id": columns[1], "n_tokens": pa.array(np.diff(ends).astype(np.int32)), "ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32)))}

        return f

    out = map_text(rows, make, f"part int, at long, doc_id {kind}, n_tokens int, ids array<int>", 2)
    writer = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false", "parquet.block.size": row_group_mb << 20, "parquet.page.size": page_kb << 10, "compression": "zstd", "maxRecordsPerFile": 0}
    out.write.options(**writer).parquet(f"{path}/tokens")
    counts = read_tokens(spark, path, "part", "n_tokens").groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("n"))
    # one row for each part: its running sum is over the table of parts, not over documents
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    counts.select("part", before.alias("start")).write.parquet(f"{path}/parts")


def read_tokens(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """The stated columns of a store's rows; without ``ids``, no id is read."""
    got = spark.read.parquet(f"{path}/tokens")
    return got.select(*columns) if columns else got


def with_start(rows: DataFrame, path: str) -> DataFrame:
    """Replaces (part, at) by start, the number of ids of all rows before; call it on rows without ids where that does."""
    parts = rows.sparkSession.read.parquet(f"{path}/parts").withColumnRenamed("start", "__start")
    return rows.join(parts, "part").select((F.col("__start") + F.col("at")).alias("start"), *(c for c in rows.columns if c not in ("part", "at")))


def with_crc32(rows: DataFrame, ids_col: str = "ids") -> DataFrame:
    """Replaces the ids by the unsigned crc32 of them as little-endian unsigned 32-bit integers."""
    keep = [f for f in rows.schema.fields if f.name != ids_col]

    def run(batches):
        for b in batches:
            ids = b.column(ids_col)
            flat, at = np.asarray(ids.flatten()).astype("<u4"), np.concatenate(([0], np.cumsum(np.asarray(ids.value_lengths().fill_null(0)))))
            crc = [zlib.crc32(memoryview(flat[a:e]).cast("B") if e > a else b"") for a, e in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in keep), pa.array(crc, pa.int64())], names=[*(f.name for f in keep), "ids_crc32"])

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keep) + ", ids_crc32 long")
