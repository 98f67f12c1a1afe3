"""Documents whose word n-gram sets are alike: a blocked sparse matrix product of documents by n-grams.

The matrix has a row for each distinct set and a column for each n-gram. What could only give small products is never
multiplied; every bound is exact, so no link is lost:

* Columns are ordered by how many documents hold them, rare ones first. Two sets that are alike enough share one of the
  first columns of both, as many as their size lets differ, so only those columns put documents together. The order
  comes from counters of hashed n-grams over all documents, summed over tasks; their number is fixed, and columns that
  share a counter only stand later than they could.
* Two sizes bound the overlap; the sizes of a row's column blocks, kept as small counts, bound it closer: the sum of the
  lesser counts. Pairs below what their sizes ask for are discarded before any text is read.
* What is left is multiplied by blocks: rows of documents that share a column, n-grams a block of columns at a time.
  Overlaps add up, and after each block pairs that the columns to come cannot bring to their bound are discarded.

Documents with the same set are one row from the start, and documents that links already connect are not multiplied
again (see ``linking``), so a group of copies costs one product for each of its documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, map_text, materialise, resource, slices
from tessera.llm.linking import block_links, hub_members, near_classes, promising
from tessera.llm.minhash import BLOCK_SHINGLES, Shingler, confirmed, texts_for

#: Counters of the column order, and those of a row that carries them between tasks.
COUNTERS, SEGMENT = 1 << 24, 1 << 14
#: Columns of a row that share a small count, about.
CELL = 4


def least_overlap(n_a, n_b, threshold: int):
    """The overlap from which two sets of these sizes are linked: 100 * overlap >= threshold * union."""
    return -(-threshold * (n_a + n_b) // (100 + threshold))


def block_sizes(hashes: np.ndarray) -> bytes:
    """A set's counts over a power of two of column blocks; none if a count is over a byte (then nothing is bounded)."""
    cells = 1 << max(3, int(len(hashes) // CELL).bit_length())
    counts = np.bincount((hashes & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def folded(counts: np.ndarray, cells: int) -> np.ndarray:
    return counts.reshape(-1, cells).sum(0)


def may_reach(n_a: int, a: bytes, n_b: int, b: bytes, threshold: int) -> bool:
    """Whether the sizes and block sizes of two sets leave them an overlap that links them."""
    need = least_overlap(n_a, n_b, threshold)
    if min(n_a, n_b) < need:
        return False
    if not a or not b:
        return True
    x, y = (np.frombuffer(s, dtype=np.uint8).astype(np.int64) for s in (a, b))
    cells = min(len(x), len(y))
    return int(np.minimum(folded(x, cells), folded(y, cells)).sum()) >= need


def may_reach_all(a: list[tuple[int, bytes]], b: list[tuple[int, bytes]], threshold: int) -> np.ndarray:
    """``may_reach`` for all pairs of two lists of (size, block sizes)."""
    n_a, n_b = (np.array([s[0] for s in side], dtype=np.int64) for side in (a, b))
    need = least_overlap(n_a[:, None], n_b[None, :], threshold)
    out = np.minimum(n_a[:, None], n_b[None, :]) >= need
    cells_a, cells_b = (np.array([len(s[1]) for s in side]) for side in (a, b))
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # cells -> (place of a member, counts folded to them)
    for i in np.nonzero(out.any(1))[0]:
        if not cells_a[i]:
            continue
        counts = np.frombuffer(a[i][1], dtype=np.uint8).astype(np.int32)
        at = np.nonzero(out[i] & (cells_b > 0))[0]
        level = np.minimum(cells_b[at], cells_a[i])
        for cells in np.unique(level):
            if cells not in tables:
                who = np.nonzero(cells_b >= cells)[0]
                place = np.zeros(len(b), dtype=np.int64)
                place[who] = np.arange(len(who))
                tables[cells] = place, np.stack([folded(np.frombuffer(b[j][1], dtype=np.uint8).astype(np.int32), cells) for j in who])
            js = at[level == cells]
            place, rows = tables[cells]
            out[i, js] = np.minimum(rows[place[js]], folded(counts, cells)).sum(1) >= need[i, js]
    return out


def linked_pairs(a: list[np.ndarray], b: list[np.ndarray], threshold: int) -> list[tuple[int, int]]:
    """(i, j) of the linked ones of two lists of sets: the product of their incidence matrices, a column block at a time."""
    flat = np.concatenate([*a, *b, np.zeros(0, np.uint64)])
    _, inverse, times = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1  # columns of one row alone add nothing
    column = np.where(times > 1, number, -1)[inverse]
    row = np.repeat(np.arange(len(a) + len(b)), [len(s) for s in (*a, *b)])
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    size = np.array([len(s) for s in (*a, *b)], dtype=np.int64)
    need = least_overlap(size[: len(a), None], size[None, len(a) :], threshold)
    left = np.bincount(row, minlength=len(size))  # a row's columns to come
    overlap = np.zeros(need.shape, dtype=np.int64)
    alive = (np.minimum(left[: len(a), None], left[None, len(a) :]) >= need) & (need > 0)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, BLOCK_SHINGLES):
        x, y = np.searchsorted(column, [start, start + BLOCK_SHINGLES])
        rows_a, rows_b = np.nonzero(alive.any(1))[0], np.nonzero(alive.any(0))[0]
        if not len(rows_a):
            break
        place = np.full(len(size), -1)
        place[rows_a], place[len(a) + rows_b] = np.arange(len(rows_a)), len(rows_a) + np.arange(len(rows_b))
        at, c = place[row[x:y]], column[x:y] - start
        has = np.zeros((len(rows_a) + len(rows_b), min(BLOCK_SHINGLES, int(column[-1]) + 1 - start)), dtype=np.float32)
        has[at[at >= 0], c[at >= 0]] = 1
        overlap[np.ix_(rows_a, rows_b)] += (has[: len(rows_a)] @ has[len(rows_a) :].T).astype(np.int64)
        left = left - np.bincount(row[x:y], minlength=len(size))
        alive &= overlap + np.minimum(left[: len(a), None], left[None, len(a) :]) >= need
    return list(zip(*(x.tolist() for x in np.nonzero(alive))))


def shingler_of(words: int) -> Shingler:
    return resource(f"shingler:{words}", lambda: Shingler(words))


def packed(counts: np.ndarray) -> bytes:
    """A segment's counters by zstd, after their width: a task's are mostly zeros and ones."""
    return bytes([counts.itemsize]) + pa.Codec("zstd").compress(counts.tobytes(), asbytes=True)


def unpacked(counts: bytes) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(counts[1:], SEGMENT * counts[0], asbytes=True), dtype=f"u{counts[0]}")


def sketches_and_counts(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(doc_id, n, digest, sizes) of every row, and the task's counters as (segment, counts); segment tells them apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, counters = shingler_of(words), np.zeros(COUNTERS, dtype=np.uint32)
        names = ["doc_id", "n", "digest", "sizes", "segment", "counts"]
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for x, y in slices(lengths):
                part = batch.slice(x, y - x)
                sets = [shingler.hashes(t or "") for t in part.column(1).to_pylist()]
                np.add.at(counters, (np.concatenate(sets) >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64), np.uint32(1))
                columns = [part.column(0), pa.array([len(h) for h in sets], pa.int64()), pa.array([hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None for h in sets], pa.binary()), pa.array([block_sizes(h) if len(h) else None for h in sets], pa.binary()), pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        each = counters.reshape(-1, SEGMENT)
        some = np.nonzero(each.any(1))[0]
        counts = [packed(c.astype(np.min_scalar_type(int(c.max())))) for c in each[some]]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(some), t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.binary())] + [pa.array(some.astype(np.int32)), pa.array(counts, pa.binary())], names=names)

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, n long, digest binary, sizes binary, segment int, counts binary")


def column_order(counts: DataFrame) -> np.ndarray:
    """The counters summed over tasks, as bytes of 8 * log2: COUNTERS of them, whatever the table's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums.setdefault(segment, np.zeros(SEGMENT, dtype=np.uint64))[:] += unpacked(c)
        top = [np.minimum(8 * np.log2(np.maximum(s, 1)), 255).astype(np.uint8).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(top, pa.binary())], names=["segment", "counts"])

    out = np.zeros((COUNTERS // SEGMENT, SEGMENT), dtype=np.uint8)
    for segment, c in counts.repartition("segment").mapInArrow(run, "segment int, counts binary").collect():
        out[segment] = np.frombuffer(c, dtype=np.uint8)
    return out.ravel()


def first_columns(hashes: np.ndarray, order: np.ndarray, threshold: int) -> np.ndarray:
    """Of a set's columns in order, rare ones first, those of which a linked set holds one."""
    n = len(hashes)
    held = order[(hashes >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)]
    return hashes[np.lexsort((hashes, held))[: n + (-threshold * n // 100) + 1]]


def similar_sets(docs: DataFrame, words: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every input row.

    Two documents are linked if 100 * intersection >= ``threshold`` * union of their sets of ``words``-word shingles of
    lower-cased (A-Z), white-space separated words; with fewer words the whole sequence is one. component_id is the
    smallest doc_id that links reach. Null and empty texts and texts of white space have empty sets and are linked with
    nothing; so are rows whose doc_id is null (component null). Repeated rows give repeated rows; rows with one doc_id
    and different texts count as one document. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    found = materialise(sketches_and_counts(docs, id_col, text_col, words), "sketches")
    sketches = found.filter("segment IS NULL").select("doc_id", "n", "digest", "sizes")
    usable = sketches.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    sets = materialise(usable.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("sizes").alias("sizes")), "sets")
    order = spark.sparkContext.broadcast(column_order(found.filter("segment IS NOT NULL").select("segment", "counts")))
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))

    def make():
        shingler = shingler_of(words)

        def f(columns, rows):
            keys = [first_columns(shingler.hashes(t), order.value, threshold) for t in rows]
            ends = np.cumsum([0, *(len(k) for k in keys)]).astype(np.int32)
            return {"node": columns[0], "keys": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64)))}

        return f

    # a text's columns move to meet the sets' nodes, not the text
    keys = map_text(texts_for(texts, sets.select("node")), make, "node long, keys array<long>", 1)
    keys = keys.join(sets.select("node").distinct(), "node", "left_semi").select("node", F.explode("keys").alias("key"))
    members = materialise(keys, "keys")
    buckets = materialise(hub_members(members), "buckets")
    discard(members)
    texts = materialise(texts_for(texts, buckets.select("node")), "texts")

    def check(pairs: DataFrame) -> DataFrame:
        side = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sizes").alias(f"sizes_{x}"))
        need = F.ceil(threshold * (F.col("n_a") + F.col("n_b")) / (100 + threshold))
        sized = pairs.join(side("a").drop("sizes_a"), "a").join(side("b").drop("sizes_b"), "b").filter(F.least("n_a", "n_b") >= need).select("a", "b")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b, n_a, s_a, n_b, s_b = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "n_a", "sizes_a", "n_b", "sizes_b"))
                keep = [may_reach(*x, threshold) for x in zip(n_a.to_pylist(), s_a.to_pylist(), n_b.to_pylist(), s_b.to_pylist())]
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in (a, b)], names=["a", "b"])

        likely = sized.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long").distinct()
        return confirmed(materialise(likely, "likely"), texts, words, threshold)

    def bounds():
        return lambda a, b, asked: may_reach_all([(int.from_bytes(s[:8], "big"), s[8:]) for s in a], [(int.from_bytes(s[:8], "big"), s[8:]) for s in b], threshold)

    def product():
        shingler = shingler_of(words)
        return shingler.hashes, lambda a, b: linked_pairs(a, b, threshold), lambda pairs: [True] * len(pairs)

    carried = sets.select("node", F.concat(F.to_binary(F.lpad(F.hex("n"), 16, "0"), F.lit("hex")), "sizes").alias("sketch"))
    components, _ = near_classes(buckets, check, lambda groups: block_links(promising(groups, carried, bounds), texts, product))
    of = sets.select("digest", "node").join(components, "node", "left").select(F.col("digest").alias("of"), F.coalesce("component", "node").alias("component"))
    out = sketches.join(of, F.col("digest") == F.col("of"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
