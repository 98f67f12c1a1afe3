"""Benchmark decontamination by pigeonhole edit matching.

Texts are folded (lower case, runs of anything but letters and digits as one blank, a blank at either end, so that
an item that stands inside a longer word differs by its borders). A test item of m folded characters may differ by ``k = floor(budget * m)`` edits from a passage of a document; it is split into k + 1 pieces, of which at
least one is in any such passage unchanged. One automaton of all pieces finds the exact hits; a hit fixes the
stretch of document in which the item can lie, and Myers' bit-parallel recurrence over that stretch gives the least
edit distance of the whole item to any substring of it.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, map_text, materialise, resource

#: Edits for each character of an item.
BUDGET = 0.06
#: Characters of items that one pass over the documents takes: bounds the automaton that goes to the executors.
ITEMS_AT_ONCE = 4_000_000

FOLD = re.compile(r"[\W_]+")


def fold(text: str) -> str:
    """Empty for texts without letters and digits."""
    words = FOLD.sub(" ", text.lower()).strip()
    return f" {words} " if words else ""


def pieces(item: str, budget: float) -> list[tuple[int, str]]:
    """(offset, piece): k + 1 pieces of nearly equal length."""
    m = len(item)
    n = int(budget * m) + 1
    cuts = [m * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Pattern:
    """Myers' bit vectors of one item; the distance of the whole item to the best substring of a text."""

    def __init__(self, item: str):
        self.m = len(item)
        self.peq: dict[str, int] = {}
        for i, c in enumerate(item):
            self.peq[c] = self.peq.get(c, 0) | 1 << i

    def search(self, text: str, limit: int) -> tuple[int, int]:
        """(least distance, end of the first substring that has it); limit + 1 if none is within the limit."""
        m, peq = self.m, self.peq
        ones, top = (1 << m) - 1, 1 << (m - 1)
        pv, mv, score = ones, 0, m
        best, end = limit + 1, 0
        for i, c in enumerate(text):
            eq = peq.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv) & ones, pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph, mh = ph << 1 & ones, mh << 1 & ones  # a match may start anywhere: the first row is zero
            pv, mv = mh | ~(xv | ph) & ones, ph & xv
            if score < best:
                best, end = score, i + 1
        return best, end


class Matcher:
    """Built from (item_id, folded text) of one bounded block of items."""

    def __init__(self, items: list[tuple[int, str]], budget: float):
        self.items = items
        self.limits = [int(budget * len(t)) for _, t in items]
        self.patterns: dict[int, Pattern] = {}
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text) in enumerate(items):
            for at, piece in pieces(text, budget):
                places.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, distance, end in the folded text) of each item that a text holds, least distance first found."""
        if not self.items or not text:
            return []
        stretches: dict[int, list[list[int]]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for n, at in where:
                k, m = self.limits[n], len(self.items[n][1])
                start = end + 1 - size - at
                a, b = max(0, start - k), min(len(text), start + m + k)
                of = stretches.setdefault(n, [])
                if of and a <= of[-1][1] and b >= of[-1][0]:  # stretches that meet are one: none is searched twice
                    of[-1][0], of[-1][1] = min(a, of[-1][0]), max(b, of[-1][1])
                else:
                    of.append([a, b])
        out = []
        for n, of in stretches.items():
            item, k = self.items[n][1], self.limits[n]
            best, end = k + 1, 0
            for a, b in of:
                exact = text.find(item, a, b)
                if exact >= 0:
                    best, end = 0, exact + len(item)
                    break
                if k:
                    d, e = self.patterns.setdefault(n, Pattern(item)).search(text[a:b], k)
                    if d < best:
                        best, end = d, a + e
            if best <= k:
                out.append((self.items[n][0], best, end))
        return sorted(out)


def item_blocks(items: DataFrame, id_col: str, text_col: str, at_once: int) -> Iterator[list[tuple[int, str]]]:
    """Folded items in blocks of at most ``at_once`` characters (a longer item alone); empty ones are left out."""
    block: list[tuple[int, str]] = []
    held = 0
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    for r in rows.toLocalIterator():
        text = fold(r["text"])
        if not text:
            continue
        if block and held + len(text) > at_once:
            yield block
            block, held = [], 0
        block.append((r["id"], text))
        held += len(text)
    if block:
        yield block


def contaminated(docs: DataFrame, items: DataFrame, budget: float = BUDGET, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", at_once: int = ITEMS_AT_ONCE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep..., hits array<struct<item_id, distance, end>>) for every input row; hits are sorted by item_id.

    ``end`` is where the match ends in the folded document. Null and empty documents have no hits; null, empty and
    id-less items are never found; items that occur twice are found twice. Long documents are searched whole.
    Repeated rows give repeated rows, an empty table an empty result; columns outside ``keep`` are not read. The items are the
    stated query set: they go to the executors in blocks of ``at_once`` characters, one pass over the documents a block,
    written out in between, so that one block and one automaton a worker are held at a time.
    """
    spark = docs.sparkSession
    kinds, item_kind = dict(docs.dtypes), dict(items.dtypes)[item_id_col]
    struct = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("end", pa.int64())]))
    if item_kind not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError(f"{item_id_col} must be an integer, not {item_kind}")
    hits_type = "array<struct<item_id:bigint,distance:int,end:bigint>>"
    names = ["__id", "__text", "__hits", *(f"__{i}" for i in range(len(keep)))]
    rows = docs.select(F.col(id_col), F.col(text_col), F.array().cast(hits_type), *(F.col(f"`{k}`") for k in keep)).toDF(*names)
    schema = ", ".join(f"{n} {t}" for n, t in zip(names, (kinds[id_col], "string", hits_type, *(kinds[k] for k in keep))))
    blocks = item_blocks(items, item_id_col, item_text_col, at_once)
    block, written = next(blocks, None), None
    while block:
        shared, key, block = spark.sparkContext.broadcast(block), f"matcher:{uuid.uuid4().hex}", next(blocks, None)
        last = block is None  # the last pass hands no text on

        def make(shared=shared, key=key, last=last):
            matcher = resource(key, lambda: Matcher(shared.value, budget))

            def f(columns, texts):
                hits = [[*before, *({"item_id": i, "distance": d, "end": e} for i, d, e in matcher.find(fold(t)))] for before, t in zip(columns[2].to_pylist(), texts)]
                return dict(zip(names, (columns[0], pa.nulls(len(texts), pa.string()) if last else columns[1], pa.array(hits, struct), *columns[3:])))

            return f

        rows = map_text(rows, make, schema, 1)
        if not last:
            before, rows = written, materialise(rows, "hits")
            written = rows
            shared.destroy()
            if before is not None:
                discard(before)
    kept = [F.col(n).alias(k) for n, k in zip(names[3:], keep)]
    return rows.select(F.col("__id").alias("doc_id"), *kept, F.array_sort("__hits").alias("hits"))
