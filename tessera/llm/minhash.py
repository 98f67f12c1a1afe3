"""Near-duplicate documents by SetSketch registers.

A document's set of word shingles is sketched in ``M`` registers: register i holds floor(1 - log_B x), where x is the
least of exponentially distributed values that the shingles draw from hash i. Registers are maxima, so sketches of
parts merge, and two registers agree with a probability near the sets' Jaccard similarity. Bands of registers give
candidate buckets; for a pair, registers that lie above, below and level give the similarity's maximum-likelihood
estimate together with the known set sizes; pairs not clearly below the threshold are checked on their full sets.
Documents with the same set are one node from the start, so copies never meet as pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Memo, map_text, materialise, resource, shuffle_partitions
from tessera.llm.linking import block_links, hub_members, near_classes, promising

#: Registers, base and rate of the sketch; bands of ROWS registers. A pair at 0.85 misses all 32 bands of 4 with a
#: probability of 6e-11, one at 0.8 with 5e-8.
M, BASE, RATE, ROWS = 128, 1.001, 20.0, 4
#: Estimates this far below the threshold (over 5 standard deviations of 128 registers) are not checked.
MARGIN = 0.18
#: Members that are checked against one copy of their hub's text.
HUB_SHARE = 256
#: Bits of the filter that finds the texts of documents that met: what is broadcast has 2^19 rows of 64 at most, however many there are.
FILTER_BITS = 1 << 25
#: Shingles that one step of a block's count takes: bounds its memory.
BLOCK_SHINGLES = 16_384

_random = np.random.Generator(np.random.PCG64(20))
FLIPS = _random.integers(0, 1 << 32, M, dtype=np.uint32)
ODDS = _random.integers(0, 1 << 31, M, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
LANES = _random.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Shingler:
    """Sets of word n-gram hashes (64 bits) of lower-cased (A-Z only), ASCII white-space separated words."""

    def __init__(self, words: int):
        self.words = words
        self.memo = Memo(xxhash.xxh3_64_intdigest)

    def hashes(self, text: str) -> np.ndarray:
        """Sorted distinct shingle hashes. A text with fewer words is one shingle, one without words none."""
        split = text.encode("utf-8", "surrogatepass").lower().split()
        n = len(split)
        if not n:
            return np.zeros(0, dtype=np.uint64)
        h = np.fromiter(map(self.memo.__getitem__, split), dtype=np.uint64, count=n)
        k = min(n, self.words)
        out = np.full(n - k + 1, k, dtype=np.uint64)
        for i in range(k):
            out ^= h[i : n - k + 1 + i]
            out *= LANES[i % 16]
            out ^= out >> np.uint64(32)
        return np.unique(out)


def registers(hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers of a non-empty set, as 16-bit numbers."""
    low = (hashes ^ hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(M, 0xFFFFFFFF, dtype=np.uint32)
    for a in range(0, len(low), 512):  # stays in the processor's cache
        least = np.minimum(least, ((low[a : a + 512, None] ^ FLIPS) * ODDS).min(axis=0))
    x = -np.log1p(-(least + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)) + 1000, 0, 65535).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches [pair, register] with known set sizes (base near 1)."""
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    level = a.shape[1] - above - below
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    p, q = u**2 * (level + below), v**2 * (level + above)
    return (p + q - np.sqrt((p - q) ** 2 + 4 * below * above * u**2 * v**2)) / (2 * a.shape[1] * u * v)


def sketch(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(doc_id, n, digest, sig) of every row; digest identifies the set, both are null for empty sets."""

    def make():
        shingler = resource(f"shingler:{words}", lambda: Shingler(words))

        def f(columns, texts):
            n, digests, sigs = [], [], []
            for t in texts:
                h = shingler.hashes(t)
                n.append(len(h))
                digests.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                sigs.append(registers(h).tobytes() if len(h) else None)
            return {"doc_id": columns[0], "n": pa.array(n, pa.int64()), "digest": pa.array(digests, pa.binary()), "sig": pa.array(sigs, pa.binary())}

        return f

    return map_text(docs.select(F.col(id_col).cast("long"), text_col), make, "doc_id long, n long, digest binary, sig binary", 1)


def estimated(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose estimate reaches ``least``."""
    a = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    b = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                got = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
                x, y = (np.frombuffer(b"".join(got[c].to_pylist()), dtype=np.uint16).reshape(-1, M) for c in ("sig_a", "sig_b"))
                keep = estimate(x, y, np.asarray(got["n_a"]), np.asarray(got["n_b"])) >= least
                yield pa.RecordBatch.from_arrays([got[c].filter(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])

    return pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, threshold: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= threshold * union on full sets; ``texts`` holds (node, text).

    The members of a hub ``a`` come in shares of ``HUB_SHARE``, each with a copy of the hub's text in front.
    """
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_SHARE).cast("int").alias("shares"))
    hubs = shares.join(texts, F.col("a") == F.col("node")).select("a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(None).cast("long").alias("b"), "text")
    members = pairs.join(shares, "a").join(texts, F.col("b") == F.col("node"))
    members = members.select("a", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("share"), "b", "text")
    rows = hubs.unionByName(members).repartition(shuffle_partitions(pairs), "a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = resource(f"shingler:{words}", lambda: Shingler(words))
        at, hub = None, []
        for batch in batches:
            got: list[tuple[int, int]] = []
            for a, share, b, text in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (a, share):
                    at, hub = (a, share), []
                own = shingler.hashes(text or "")
                if b is None:
                    hub.append(own)
                    continue
                for h in hub:
                    both = len(np.intersect1d(h, own, assume_unique=True))
                    if both and 100 * both >= threshold * (len(h) + len(own) - both):
                        got.append((a, b))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``a`` with all of ``b``: a product of their incidence matrices."""
    flat = np.concatenate([*a, *b, np.zeros(0, np.uint64)])
    values, inverse, times = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1  # shingles of one set alone are in no intersection
    column = np.where(times > 1, number, -1)[inverse]
    row = np.repeat(np.arange(len(a) + len(b)), [len(s) for s in (*a, *b)])
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, BLOCK_SHINGLES):
        x, y = np.searchsorted(column, [start, start + BLOCK_SHINGLES])
        has = np.zeros((len(a) + len(b), BLOCK_SHINGLES), dtype=np.float32)
        has[row[x:y], column[x:y] - start] = 1
        out += has[: len(a)] @ has[len(a) :].T
    return out.astype(np.int64)


def rows_for(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows(node, ...)`` without most of the rows that are not in ``nodes(node)``; none that is in it gets lost.

    A filter of ``FILTER_BITS`` bits goes to the tasks that read the rows, so that no row is shuffled to be left out.
    Nodes that share a bit pass with one another, and the joins that follow tell them apart.
    """
    place = F.pmod("node", F.lit(FILTER_BITS))
    bit = F.expr("shiftleft(1L, CAST(pmod(node, 64L) AS INT))")
    words = nodes.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    return rows.join(F.broadcast(words), F.shiftright(place, 6) == F.col("word")).filter(F.col("bits").bitwiseAND(bit) != 0).select(*rows.columns)


def texts_for(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``texts(node, text)`` without most of the rows that are not in ``nodes(node)``, as :func:`rows_for` has it."""
    return rows_for(texts.select("node", "text"), nodes)


def block_estimator(least: float):
    """What ``linking.promising`` needs to rule out sets by their sketches (n as 8 bytes, then the registers)."""

    def make():
        def may_link(a: list[bytes], b: list[bytes], asked: np.ndarray) -> np.ndarray:
            (n_a, x), (n_b, y) = ((np.array([int.from_bytes(s[:8], "big") for s in side]), np.frombuffer(b"".join(s[8:] for s in side), dtype=np.uint16).reshape(-1, M)) for side in (a, b))
            out = np.zeros((len(a), len(b)), dtype=bool)
            for i in range(len(a)):  # a row of the block at a time bounds its memory
                j = np.nonzero(asked[i])[0]
                if len(j):
                    out[i, j] = estimate(np.broadcast_to(x[i], (len(j), M)), y[j], np.full(len(j), n_a[i]), n_b[j]) >= least
            return out

        return may_link

    return make


def block_counter(words: int, threshold: int):
    """What ``linking.block_links`` needs to tell linked sets of shingles."""

    def make():
        shingler = resource(f"shingler:{words}", lambda: Shingler(words))

        def candidates(a: list[np.ndarray], b: list[np.ndarray]) -> Iterator[tuple[int, int]]:
            both = common_counts(a, b)  # the full sets are counted at once: what comes out is linked
            sizes_a, sizes_b = (np.array([len(s) for s in side], dtype=np.int64) for side in (a, b))
            at = np.nonzero((both > 0) & (100 * both >= threshold * (sizes_a[:, None] + sizes_b[None, :] - both)))
            return zip(*(x.tolist() for x in at))

        return shingler.hashes, candidates, lambda pairs: [True] * len(pairs)

    return make


def near_duplicates(docs: DataFrame, words: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every input row.

    Two documents are linked if 100 * intersection >= ``threshold`` * union of their shingle sets; component_id is the
    smallest doc_id that can be reached, kept marks the document that has it. Null and empty texts and texts of
    white space have empty sets and are linked with nothing; so are rows whose doc_id is null (they are kept).
    Repeated rows give repeated rows; rows with one doc_id and different texts count as one document. doc_id must be
    an integer. An empty table gives an empty result; other columns are not read.
    """
    sketches = materialise(sketch(docs, id_col, text_col, words), "sketches")
    usable = sketches.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    sets = materialise(usable.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("sig").alias("sig")), "sets")
    band = [F.struct(F.xxhash64(F.lit(i), F.substring("sig", 2 * ROWS * i + 1, 2 * ROWS)).alias("key")) for i in range(M // ROWS)]
    buckets = materialise(hub_members(sets.select("node", F.inline(F.array(*band)))), "buckets")
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
    texts = materialise(texts_for(texts, buckets.select("node")), "texts")
    least = threshold / 100 - MARGIN
    # a long as 8 bytes, most significant first
    carried = sets.select("node", F.concat(F.to_binary(F.lpad(F.hex("n"), 16, "0"), F.lit("hex")), "sig").alias("sketch"))

    def check(pairs: DataFrame) -> DataFrame:
        return confirmed(materialise(estimated(pairs, sets, least), "likely"), texts, words, threshold)

    components, _ = near_classes(buckets, check, lambda groups: block_links(promising(groups, carried, block_estimator(least)), texts, block_counter(words, threshold)))
    found = sets.select("digest", "node").join(components, "node", "left").select(F.col("digest").alias("of"), F.coalesce("component", "node").alias("component"))
    out = sketches.join(found, F.col("digest") == F.col("of"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
