"""Documents from scan to chunks: clean, gate, dedup, window, upsert, count."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.phrases import filled
from tessera.sources.storage import materialise

SEPARATORS = ("\n\n", "\n", ". ", " ")
CHUNK_SIZE, CHUNK_OVERLAP = 512, 64


def dedup_first(docs: DataFrame, text_col: str = "text", scope: tuple[str, ...] = ("source",), order: str = "ord") -> DataFrame:
    """The first row of each content hash within its scope (one source); ``order`` tells rows apart.

    Hashes alone are aggregated, and combined before the shuffle; texts move once, to meet the places that stay, and not
    at all where the caller asks for other columns only.
    """
    hashed = docs.select(*scope, order, X.content_hash(F.col(text_col)).alias("__hash"))
    firsts = hashed.groupBy(*scope, "__hash").agg(F.min(order).alias("__first")).select("__first")
    return docs.join(firsts, F.col(order) == F.col("__first"), "left_semi")


def clean_documents(docs: DataFrame, text_col: str = "text", min_chars: int = X.MIN_CHARS, min_words: int = X.MIN_WORDS, scope: tuple[str, ...] = ("source",), order: str = "ord", compose: bool = True) -> DataFrame:
    """Cleaned text, quality gate, dedup; all other columns stay.

    Texts are cleaned once: the gate and the hash look at what is written out, where a filter that Spark moves below the
    cleaning would do it again for each of its terms.
    """
    cleaned = materialise(docs.withColumn(text_col, X.clean_text(F.col(text_col), compose)), "cleaned")
    return dedup_first(cleaned.filter(~X.is_low_quality(F.col(text_col), min_chars, min_words)), text_col, scope, order)


def first_n(docs: DataFrame, n: int, order: str = "ord") -> DataFrame:
    """A scan with an early stop, before cleaning."""
    return docs.orderBy(order).limit(n)


def split_recursive(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> Iterator[str]:
    """Splits by the first separator that occurs and merges pieces up to ``size`` characters, ``overlap`` of them shared.

    Pieces that are too long are split by the next separators; a word longer than ``size`` stays whole. Chunks come one
    by one: what is held is one merge of pieces, not all chunks of a text.
    """
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    sep, finer = separators[at], separators[at + 1 :]
    fitting: list[str] = []
    for p in _keep_separator(text, sep):
        if not p:
            continue
        if len(p) < size:
            fitting.append(p)
            continue
        yield from _merged(fitting, size, overlap)
        fitting = []
        if finer:
            yield from split_recursive(p, size, overlap, finer)
        else:
            yield p
    yield from _merged(fitting, size, overlap)


def _keep_separator(text: str, sep: str) -> Iterator[str]:
    """Pieces that begin with the separator before them."""
    start, at = 0, text.find(sep)
    while at >= 0:
        yield text[start:at]
        start, at = at, text.find(sep, at + len(sep))
    yield text[start:]


def _merged(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    held: deque[str] = deque()
    total = 0
    for p in pieces:
        if held and total + len(p) > size:
            if chunk := "".join(held).strip():
                yield chunk
            while held and (total > overlap or total + len(p) > size):
                total -= len(held.popleft())
        held.append(p)
        total += len(p)
    if chunk := "".join(held).strip():
        yield chunk


def chunks(docs: DataFrame, text_col: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """``docs`` without the text, with (i, chunk): the recursive splitter as a table function that yields a text's chunks.

    Chunks come back as rows, ``i`` from 0 in each text, as they are made. Null and empty texts have no chunks; repeated
    rows give repeated chunks.
    """

    class Splitter:
        def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
            yield from enumerate(split_recursive(text, size, overlap) if text else ())

    split = F.udtf(Splitter, returnType="i int, chunk string")
    rest = [c for c in docs.columns if c != text_col]
    # the laterally joined function sees its row's text only, so other columns' names cannot clash with its own
    rows = docs.select(F.struct(F.lit(0).alias("__"), *rest).alias("__rest"), F.col(text_col).alias("__text"))
    told = rows.lateralJoin(split(F.col("__text").outer(), F.lit(size), F.lit(overlap)))
    return told.select(*(F.col(f"__rest.`{c}`").alias(c) for c in rest), "i", "chunk")


def chunk_id(source: Column, i: Column, chunk: Column) -> Column:
    return F.md5(F.concat_ws("_", source, i.cast("string"), F.substring(chunk, 1, 64)).cast("binary"))


def upsert(chunked: DataFrame, order: str, source_col: str = "source") -> DataFrame:
    """(id, ...) with the last row of each id: later chunks of a source overwrite those with the same start."""
    keyed = chunked.withColumn("id", chunk_id(F.col(source_col), F.col("i"), F.col("chunk")))
    rest = [c for c in chunked.columns]
    return keyed.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct(order, "i")).alias("r")).select("id", "r.*")


def run_stats(raw: DataFrame, kept: DataFrame, chunked: DataFrame, by: str = "source") -> DataFrame:
    """(by, raw, kept, chunks): how many rows each stage left."""
    tagged = [d.groupBy(by).agg(F.count("*").alias("n")).withColumn("stage", F.lit(n)) for n, d in (("raw", raw), ("kept", kept), ("chunks", chunked))]
    long = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    return long.groupBy(by).agg(*(F.coalesce(F.sum(F.when(F.col("stage") == n, F.col("n"))), F.lit(0)).alias(n) for n in ("raw", "kept", "chunks")))


def annotation_text(element: Column, season: Column, year: Column, context: Column) -> Column:
    """An expert's annotation as a passage for the store."""
    return filled("Fashion trend analysis: {e} in {s} {y}. Context: {c}", e=element, s=season, y=year.cast("string"), c=context)
