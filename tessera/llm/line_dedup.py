"""Near-duplicate lines by a segment-partition edit join.

Two lines may differ by the edits that a :class:`Budget` allows the shorter one, t. The shorter line is split into
t + 1 segments of nearly equal length, of which one at least is in the longer line unchanged: the j-th at most j places
away, and at most t - j seen from the end. The longer line probes the substrings of a segment's length at those places.
Segments and substrings are looked up by their minimizer: the least hash of the k-grams in them. Equal strings have
equal minimizers, and neighbouring substrings mostly share theirs, so a line gives one key for each run of substrings
with one minimizer that is probed instead of t times t probes. Each key says whether a segment starts in its run (the
index) and carries the classes of the line's length and of the place, so that only lines of about one length meet, at
about one place.

Keys travel packed by partition; a key that many lines of one batch share leaves the batch once, its lines go on
spread out. Lines that meet are classed by hubs and blocks (:mod:`tessera.llm.linking`); letter counts leave out most
false candidates, and a banded bit-parallel edit distance decides. Equal lines are one node from the start: a node is
the line's 64-bit hash, its classes are told by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import located, materialise, release, shuffle_partitions, slices
from tessera.llm.linking import block_links, hub_members, near_classes, promising
from tessera.llm.minhash import rows_for, texts_for

#: Unicode's white space without the line feed.
WHITE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


@dataclass(frozen=True)
class Budget:
    """Edits that a line of n characters and a longer one may differ by: ``share`` per mille of n + ``slack``, ``tau`` at least, none under ``least``."""

    share: int = 20
    slack: int = 30
    tau: int = 0
    least: int = 0

    def of(self, n):
        n = np.asarray(n)
        return np.where(n >= self.least, np.maximum(self.tau, (n + self.slack) * self.share // 1000), 0)

    def shortest(self, t: np.ndarray) -> np.ndarray:
        """The least length at which ``t`` edits or more are allowed; beyond any length, if none is."""
        grown = -(-np.asarray(t) * 1000 // self.share) - self.slack if self.share else np.full(np.shape(t), 1 << 62)
        return np.maximum(self.least, np.where(np.asarray(t) <= self.tau, 0, grown))

    def column(self, n: Column) -> Column:
        grown = F.floor((n + F.lit(self.slack)) * F.lit(self.share) / F.lit(1000)).cast("int")
        return F.when(n >= self.least, F.greatest(F.lit(self.tau), grown)).otherwise(0)


#: One edit for each 50 characters, rounded (from 20 characters on).
BUDGET = Budget()

#: Characters of a minimizer's gram and of a segment that count at most; lengths beyond share the last level.
GRAM, SEGMENT, LONGEST = 16, 96, 1 << 20
#: Substrings that a run takes at most: what is not known of a place. Places beyond 16 bits are one.
RUN, LAST_PLACE = 48, (1 << 16) - 1
#: Characters that one step of the key maker takes (they stay in the processor's cache), and those of a line's piece.
STEP_CHARS, PIECE_CHARS = 65_536, 1 << 20
#: Characters whose letters are counted at once.
SKETCHED = 65_536
#: Key rows that a batch packs at once. A key is hot, and its lines are spread, if it has HOT lines in a batch or more
#: and more than FULL times a partition's share of the batch's rows: below that a partition holds it like any other.
PACKED, HOT, FULL = 500_000, 64, 1
#: Bits of the filter that finds the lines that met: what is broadcast has this size however many there are.
FILTER_BITS = 1 << 25


def segments(n: int, tau: int) -> list[tuple[int, int]]:
    """(start, length) of tau + 1 segments of nearly equal length; the longer ones come last."""
    k = tau + 1
    short, longer = n // k, n % k
    out, at = [], 0
    for i in range(k):
        size = short + (i >= k - longer)
        out.append((at, size))
        at += size
    return out


@dataclass(frozen=True)
class Level:
    """Lines of ``low`` to ``high`` - 1 characters: gram length and grams in a window."""

    low: int
    high: int
    k: int
    w: int


@cache
def levels(budget: Budget) -> list[Level]:
    """The levels of all lengths at which a line may have an edit."""
    n = np.arange(LONGEST + 1)
    most = budget.of(n)
    run = n // (most + 1)
    if not most[-1]:
        return []
    out, low = [], max(int(np.argmax(most > 0)), 1)
    while low < LONGEST:
        high = min(max(low * 3 // 2, low + 1), LONGEST)
        r = max(1, min(int(run[low:high].min()), SEGMENT))
        k = max(1, min(GRAM, (3 * r + 4) // 5))
        out.append(Level(low, high, k, r - k + 1))
        low = high
    last = out[-1]
    return [*out[:-1], Level(last.low, 1 << 62, last.k, last.w)]


#: Stands for the length class of a hot key's one row; classes of lengths are lower.
HOT_CLASS = (1 << 15) - 1
#: The bit of a tag that marks an index segment; the rest of it is the length class.
INDEXED = 1 << 15


@cache
def length_classes(budget: Budget) -> tuple[np.ndarray, np.ndarray]:
    """Where the classes of lengths start, each wider than the budget of any line below its end, and the widths of their classes of places."""
    starts = [0]
    while starts[-1] < LONGEST and len(starts) < HOT_CLASS - 1:
        starts.append(starts[-1] + int(budget.of(starts[-1])) + 4)
        while starts[-1] - starts[-2] <= int(budget.of(starts[-1])):
            starts[-1] += 1
    widths = [RUN + int(budget.of(end)) + 1 for end in starts[1:]] + [LAST_PLACE + 1] * 2  # all lines beyond are at one place
    return np.array(starts), np.array(widths)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k codes, by doubling."""
    h, size = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 1
    h ^= h >> np.uint64(29)
    while size < k:
        step = min(size, k - size)
        h = h[:-step] * np.uint64(0xBF58476D1CE4E5B9) + h[step:]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        size += step
    return h


def window_least(h: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size < w:
        step = min(size, w - size)
        h = np.minimum(h[:-step], h[step:])
        size += step
    return h


def pieces(line: str, reach: int) -> Iterator[tuple[int, str]]:
    """(start, part) of a line in parts that overlap by ``reach`` - 1 characters: each window is whole in one."""
    for a in range(0, max(1, len(line) - reach + 1), PIECE_CHARS):
        yield a, line[a : a + PIECE_CHARS + reach - 1]


def line_keys(lines: list[str], budget: Budget) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key of 48 bits, number of the line, length class with the index mark, place) of all lines' runs."""
    sizes = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    least = sizes - budget.of(sizes)  # a shorter partner has at least so many characters
    classes = np.searchsorted(length_classes(budget)[0], sizes, "right") - 1
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint16), np.zeros(0, np.uint16))]
    for number, level in enumerate(levels(budget)):
        chosen = np.nonzero((sizes >= level.low) & (least < level.high))[0]
        parts: list[tuple[int, int, str]] = []
        held = 0
        for i in chosen.tolist():
            for a, part in pieces(lines[i], level.k + level.w - 1) if len(lines[i]) > PIECE_CHARS else ((0, lines[i]),):
                parts.append((i, a, part))
                held += len(part)
                if held >= STEP_CHARS:
                    out.append(runs(parts, sizes, classes, budget, level, number))
                    parts, held = [], 0
        if parts:
            out.append(runs(parts, sizes, classes, budget, level, number))
    return tuple(np.concatenate(x) for x in zip(*out))


def each_segment(most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the line, number of the segment) of all segments of lines with ``most`` edits each; -1: none."""
    k = np.maximum(most + 1, 0)
    return np.repeat(np.arange(len(k)), k), np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)


def segment_starts(n: np.ndarray, most: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Where the segment ``j`` of a line of ``n`` characters starts, as :func:`segments` has it."""
    k = most + 1
    return j * (n // k) + np.maximum(0, j - (k - n % k))


def probes(sizes: np.ndarray, budget: Budget, level: Level) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the line, least and last place) where a line of these ``sizes`` may have a segment of a shorter line of the level.

    Of t + 1 segments one at least, the j-th, is unchanged with j edits before it and t - j or fewer behind: edits less
    segments goes from 0 to -1 or less in steps of -1 or more, so it first comes to -1 by a segment without an edit, from 0.
    So that segment has moved by j places at most, and the rest of the line behind it by t - j. Lengths m of shorter
    lines with one budget are taken together: a segment's place grows with m, its distance from the end does too.
    """
    top = np.minimum(sizes, level.high - 1)
    at_most = budget.of(top)
    least = np.maximum(1, budget.of(np.maximum(level.low, sizes - budget.of(sizes))))
    for less in range(int((at_most - least).max(initial=-1)) + 1):
        t = at_most - less
        shortest = np.maximum.reduce([budget.shortest(t), sizes - t, np.full(len(t), level.low)])
        longest = np.minimum(top, budget.shortest(t + 1) - 1)
        some = np.nonzero((t >= least) & (shortest <= longest))[0]
        i, j = each_segment(t[some])
        i = some[i]
        near, far = segment_starts(shortest[i], t[i], j), segment_starts(longest[i], t[i], j)
        low = np.maximum(near - j, far + sizes[i] - longest[i] - (t[i] - j))
        high = np.minimum(far + j, near + sizes[i] - shortest[i] + (t[i] - j))
        yield i, low, high


def covered(owner: np.ndarray, low: np.ndarray, high: np.ndarray, first: np.ndarray, last: np.ndarray, start: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the runs that begin ``at`` hold a place of ``low`` to ``high`` of their part, parts having ``last`` + 1 places from ``first`` on."""
    low, high = np.maximum(low - first[owner], 0), np.minimum(high - first[owner], last[owner])
    some = low <= high
    a, b = (np.searchsorted(at, start[owner[some]] + x[some], "right") for x in (low, high))
    return np.cumsum(np.bincount(a - 1, minlength=len(at) + 1) - np.bincount(b, minlength=len(at) + 1))[: len(at)] > 0


def runs(parts: list[tuple[int, int, str]], sizes: np.ndarray, classes: np.ndarray, budget: Budget, level: Level, number: int) -> tuple:
    """The runs of one minimizer in (line, start, text) parts, of ``RUN`` substrings at most."""
    reach = level.k + level.w - 1
    line = np.array([i for i, _, _ in parts])
    first = np.array([a for _, a, _ in parts])
    size = np.array([len(t) for _, _, t in parts])
    ends = np.cumsum(size)
    start = ends - size
    codes = np.frombuffer("".join(t for _, _, t in parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    h = window_least(gram_hashes(codes, level.k), level.w)
    new = np.empty(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[start] = True
    over = (ends - reach + 1)[:, None] + np.arange(reach - 1)  # windows that would cross into the next part
    over = over[over < len(h)]
    new[over] = False
    at = np.nonzero(new)[0]
    of = np.searchsorted(start, at, "right") - 1
    until = np.minimum(np.append(at[1:], len(h)), ends[of] - reach + 1)
    if len(long := np.nonzero(until - at > RUN)[0]):
        new[np.concatenate([np.arange(a + RUN, b, RUN) for a, b in zip(at[long].tolist(), until[long].tolist())])] = True
        at = np.nonzero(new)[0]
        of = np.searchsorted(start, at, "right") - 1
    place = first[of] + at - start[of]
    # segments of lines of this level mark the runs they start in; runs without a mark stay only where a shorter line's segment may be
    most = np.where(sizes[line] < level.high, budget.of(sizes[line]), -1)
    owner, j = each_segment(most)
    begins = segment_starts(sizes[line][owner], most[owner], j)
    marked = covered(owner, begins, begins, first, size - reach, start, at)
    probed = marked.copy()
    for owner, low, high in probes(sizes[line], budget, level):
        probed |= covered(owner, low, high, first, size - reach, start, at)
    tag = classes[line[of]].astype(np.uint16)
    tag[marked] |= np.uint16(INDEXED)
    at, of, tag, place = (x[probed] for x in (at, of, tag, place))
    return mixed(h[at] ^ np.uint64(number)) >> np.uint64(16), line[of], tag, np.minimum(place, LAST_PLACE).astype(np.uint16)


#: Bytes of a packed row: step from the key before (32 bits, or 48 where keys are few), node, tag and place. The first key stands in front.
ROW, WIDE_ROW, WIDE, DENSE = 16, 18, 1 << 63, 400_000


def packed(key: np.ndarray, node: np.ndarray, tag: np.ndarray, place: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(part, blob) of sorted keys, where ``cuts`` holds the end of each part; of many keys, a rare step over 32 bits starts another blob."""
    wide = len(key) < DENSE
    steps = np.diff(key, prepend=key[:1])
    ends = np.unique(np.concatenate([cuts, [] if wide else np.nonzero(steps >> np.uint64(32))[0], [len(key)]]).astype(np.int64))
    starts = np.concatenate([[0], ends[:-1]])
    parts = np.searchsorted(cuts, starts, "right")
    low, high = (steps & np.uint64(0xFFFFFFFF)).astype("<u4"), (steps >> np.uint64(32)).astype("<u2")
    node, tag, place = node.astype("<i8"), tag.astype("<u2"), place.astype("<u2")
    for a, b, p in zip(starts.tolist(), ends.tolist(), parts.tolist()):
        if b > a:
            yield p, b"".join(((int(key[a]) | (WIDE if wide else 0)).to_bytes(8, "little"), low[a:b].tobytes(), node[a:b].tobytes(), tag[a:b].tobytes(), place[a:b].tobytes(), high[a:b].tobytes() if wide else b""))


def unpacked(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint16), np.zeros(0, np.uint16))]
    for blob in blobs:
        first = int.from_bytes(blob[:8], "little")
        n = (len(blob) - 8) // (WIDE_ROW if first & WIDE else ROW)
        steps, at = np.frombuffer(blob, "<u4", n, 8).astype(np.uint64), 8 + 4 * n
        if first & WIDE:
            steps |= np.frombuffer(blob, "<u2", n, 8 + 16 * n).astype(np.uint64) << np.uint64(32)
        steps[0] = first & ~WIDE
        out.append((np.cumsum(steps, dtype=np.uint64), np.frombuffer(blob, "<i8", n, at), np.frombuffer(blob, "<u2", n, at + 8 * n), np.frombuffer(blob, "<u2", n, at + 10 * n)))
    return tuple(np.concatenate(x) for x in zip(*out))


def line_node(line: str) -> int:
    """What Spark's xxhash64 gives for a string."""
    h = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


def lines_of(texts: list[str | None]) -> list[str]:
    """The distinct lines that are not blank, without the white space around them."""
    found: dict[str, None] = {}
    for t in texts:
        if t:
            found.update(dict.fromkeys(line.strip(WHITE) for line in t.split("\n")))
    found.pop("", None)
    return list(found)


def text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str | None]]:
    for batch in batches:
        for a, b in slices(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_pylist()):
            yield batch.column(0).slice(a, b - a).to_pylist()


def packed_keys(texts: DataFrame, budget: Budget, parts: int) -> DataFrame:
    """(part, hot, blob) of the keys of all lines in ``texts(text)``: packed key rows of a partition, or of hot keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[tuple] = []
        spread = 0

        def flush() -> pa.RecordBatch:
            nonlocal spread
            key, node, tag, place = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.argsort(key)
            key, node, tag, place = key[order], node[order], tag[order], place[order]
            edge = np.concatenate([[True], key[1:] != key[:-1]])
            times = np.diff(np.append(np.nonzero(edge)[0], len(key)))
            hot = np.repeat(times >= max(HOT, FULL * len(key) // parts), times)
            rows = []
            if hot.any():
                away = [x[hot] for x in (key, node, tag, place)]
                for a in range(0, len(away[0]), 4096):
                    rows += [(spread % parts, True, blob) for _, blob in packed(*(x[a : a + 4096] for x in away), np.zeros(0, np.int64))]
                    spread += 1
                tag = np.where(hot, np.uint16(HOT_CLASS), tag)
                keep = ~hot | edge
                key, node, tag, place = key[keep], node[keep], tag[keep], place[keep]
            cuts = np.searchsorted(key, np.array([-(-(p << 48) // parts) for p in range(1, parts)], dtype=np.uint64))
            rows += [(p, False, blob) for p, blob in packed(key, node, tag, place, cuts)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.binary())], names=["part", "hot", "blob"])

        for some in text_batches(batches):
            lines = lines_of(some)
            key, line, tag, place = line_keys(lines, budget)
            if len(key):
                held.append((key, np.array([line_node(t) for t in lines], dtype=np.int64)[line], tag, place))
            if sum(len(h[0]) for h in held) >= PACKED:
                yield flush()
        if held:
            yield flush()

    return texts.mapInArrow(run, "part int, hot boolean, blob binary")


def neighbours(key: np.ndarray, tag: np.ndarray, place: np.ndarray, budget: Budget) -> Iterator[np.ndarray]:
    """The keys together with a length class and a place class, each its own and the next: neighbours in both share one."""
    _, widths = length_classes(budget)
    own = (tag & np.uint16(INDEXED - 1)).astype(np.int64)
    for c in (own, own + 1):
        low = place.astype(np.int64) // widths[c]
        for p in (low, low + 1):
            yield mixed(key ^ mixed((c << 20 | p).view(np.uint64) + np.uint64(1))).view(np.int64)


def group_hubs(key: np.ndarray, node: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hub, node), distinct, of the groups under a key that hold two nodes or more and an index mark; the hub is the least node."""
    order = np.lexsort((node, key))
    key, node, mark = key[order], node[order], mark[order]
    at = np.nonzero(np.concatenate([np.ones(min(len(key), 1), bool), key[1:] != key[:-1]]))[0]
    if not len(at):
        return node, node
    times = np.diff(np.append(at, len(key)))
    last = np.append(at[1:], len(key)) - 1
    keep = np.repeat((node[at] != node[last]) & np.logical_or.reduceat(mark, at), times)
    hub, node = np.repeat(node[at], times)[keep], node[keep]
    order = np.lexsort((node, hub))
    hub, node = hub[order], node[order]
    new = np.concatenate([np.ones(min(len(hub), 1), bool), (hub[1:] != hub[:-1]) | (node[1:] != node[:-1])])
    return hub[new], node[new]


def meeting_lines(packs: DataFrame, budget: Budget) -> DataFrame:
    """(hub, node) of the lines that meet under a key, a length class and a place class, one of them by a segment.

    Under hot keys, whose lines are in many partitions, the rows are (key, node) with a null hub.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[bytes] = []

        def rows(key: np.ndarray, node: np.ndarray, hubs: bool) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(key), 100_000):
                own, none = pa.array(key[a : a + 100_000]), pa.nulls(len(key[a : a + 100_000]), pa.int64())
                yield pa.RecordBatch.from_arrays([none if hubs else own, own if hubs else none, pa.array(node[a : a + 100_000])], names=["key", "hub", "node"])

        for batch in batches:
            for hot, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if hot:
                    key, node, tag, place = unpacked([blob])
                    for k in neighbours(key, tag, place, budget):
                        yield from rows(k, node, False)
                else:
                    held.append(blob)
        key, node, tag, place = unpacked(held)
        held.clear()
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        met = np.zeros(len(key), bool)
        met[1:] |= same
        met[:-1] |= same
        key, node, tag, place = key[met], node[order[met]], tag[order[met]], place[order[met]]
        own = tag & np.uint16(INDEXED - 1)
        with_hot = np.isin(key, key[own == HOT_CLASS])
        for k in neighbours(*(x[with_hot & (own != HOT_CLASS)] for x in (key, tag, place)), budget):
            yield from rows(k, node[with_hot & (own != HOT_CLASS)], False)
        key, node, tag, place = (x[~with_hot] for x in (key, node, tag, place))
        if len(key):
            yield from rows(*group_hubs(np.concatenate([*neighbours(key, tag, place, budget)]), np.tile(node, 4), np.tile(tag >= INDEXED, 4)), True)

    return packs.mapInArrow(run, "key long, hub long, node long")


def met_lines(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, sketch, text) of the lines whose hash is in ``nodes(node)``, and of some others; a line of many batches comes in many rows.

    A filter of ``FILTER_BITS`` bits goes to the tasks that read the texts, so that few other lines are written.
    """
    words = nodes.selectExpr(f"shiftright(pmod(node, {FILTER_BITS}L), 6) AS word", "shiftleft(1L, CAST(pmod(node, 64L) AS INT)) AS bits")
    words = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    filled = np.zeros(FILTER_BITS // 64, np.int64)
    filled[np.asarray(words["word"].combine_chunks(), dtype=np.int64)] = np.asarray(words["bits"].combine_chunks(), dtype=np.int64)
    shared = texts.sparkSession.sparkContext.broadcast(filled.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        bits = np.frombuffer(shared.value, np.uint8)
        for some in text_batches(batches):
            lines = lines_of(some)
            found = np.array([line_node(t) for t in lines], dtype=np.int64)
            at = found.view(np.uint64) % np.uint64(FILTER_BITS)
            keep = np.nonzero(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)[0]
            kept = [lines[i] for i in keep.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(found[keep]), pa.array(sketches_of(kept), pa.binary()), pa.array(kept, pa.string())], names=["node", "sketch", "text"])

    return texts.mapInArrow(run, "node long, sketch binary, text string")


def one_each(lines: DataFrame, column: str) -> DataFrame:
    """(node, h2, column), one row a node, of ``lines(node, h2, column)``: of lines with one hash always the same counts."""
    return lines.groupBy("node").agg(F.min("h2").alias("h2"), F.min_by(column, "h2").alias(column))


def texts_of(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text), one row a node, of those in ``nodes(node)`` and some others: a filter lets few other texts be shuffled."""
    return one_each(texts_for(lines, nodes).withColumn("h2", second_hash()), "text").select("node", "text")


def second_hash() -> Column:
    return F.xxhash64(F.lit(1), "text")


def within(a: str, b: str, tau: int) -> bool:
    """Whether the edit distance is at most tau: banded bit-parallel recurrence between the common ends."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > tau:
        return False
    i, n = 0, len(b)
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : n - j]
    if not b:
        return len(a) <= tau
    # bit r of a column j stands for row j - tau + r: the band slides down with the columns
    width = 2 * tau + 1
    mask, bottom = (1 << width) - 1, 1 << (width - 1)
    rows: dict[str, int] = {}
    for r, c in enumerate(a):
        rows[c] = rows.get(c, 0) | 1 << (r + tau)
    vp, vn, score, row = mask & ~((1 << tau) - 1), 0, tau, bottom
    for col, c in enumerate(b, 1):
        pm = rows.get(c, 0) >> (col - 1) & mask
        d0 = (((pm & vp) + vp) ^ vp | pm | vn) & mask
        hp, hn = (vn | ~(d0 | vp)) & mask, d0 & vp
        if col + tau <= len(a):
            score += not d0 & bottom
        else:  # the last row has left the band's lower end
            row >>= 1
            score += bool(hp & row) - bool(hn & row)
        vp, vn = (hn | ~(d0 >> 1 | hp)) & mask, d0 >> 1 & hp
        if not col % LOOK_WIDE and col + tau <= len(a) and column_least(score, vp, vn, width) > tau:
            return False
    return score <= tau


def column_least(score: int, vp: int, vn: int, width: int) -> int:
    """The least distance in a column of the band, from its lower end's and the steps up from there; the end's distance is no less."""
    least = score
    for r in range(width - 2, -1, -1):
        score += (vn >> r & 1) - (vp >> r & 1)
        least = min(least, score)
    return least


#: The widest band that fits a machine word, and pairs that are measured side by side.
WORD_TAU, ABREAST = 31, 2048
#: Columns after which pairs that can no longer be within their budget are given up, of narrow and of wide bands.
LOOK, LOOK_WIDE = 16, 64


def coded(texts: list[str], width: int) -> np.ndarray:
    """Rows of code points, zeros behind."""
    sizes = np.array([len(t) for t in texts])
    out = np.zeros((len(texts), width), np.uint32)
    out[np.arange(width) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint32(1)
    return out


def within_all(pairs: list[tuple[str, str]], taus: list[int]) -> list[bool]:
    """``within`` for many pairs: the same recurrence for all of them at once, where a band fits a machine word."""
    out = [False] * len(pairs)
    narrow = []
    for i, ((a, b), tau) in enumerate(zip(pairs, taus)):
        if abs(len(a) - len(b)) <= tau:
            if tau <= WORD_TAU:
                narrow.append(i)
            else:
                out[i] = within(a, b, tau)
    narrow.sort(key=lambda i: max(map(len, pairs[i])))
    for start in range(0, len(narrow), ABREAST):
        some = narrow[start : start + ABREAST]
        most = np.array([taus[i] for i in some])
        for i, fits in zip(some, (banded([sorted(pairs[i], key=len) for i in some], int(most.max()), most) <= most).tolist()):
            out[i] = fits
    return out


def banded(pairs: list[list[str]], tau: int, most: np.ndarray | None = None) -> np.ndarray:
    """The edit distance of each (shorter, longer) pair if it is at most ``tau`` (31 or less), else something greater; likewise beyond a pair's ``most``."""
    most = np.full(len(pairs), tau) if most is None else most
    out, lanes = np.full(len(pairs), tau + 1), np.arange(len(pairs))
    one, width = np.uint64(1), 2 * tau + 1
    n_b, n_a = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    columns = int(n_b.max(initial=0))
    a = np.zeros((len(pairs), tau + max(int(n_a.max(initial=0)), columns) + tau + 1), np.uint32)
    a[:, tau : tau + int(n_a.max(initial=0))] = coded([p[1] for p in pairs], int(n_a.max(initial=0)))
    b = np.ascontiguousarray(coded([p[0] for p in pairs], columns).T)
    mask = np.uint64((1 << width) - 1)
    bottom = np.uint64(1 << (width - 1))
    vp = np.full(len(pairs), int(mask) & ~((1 << tau) - 1), np.uint64)
    low = np.minimum(n_a, tau)  # the last row, or the band's lower end above it
    vn, row, score = np.zeros_like(vp), one << (low + tau).astype(np.uint64), low
    same = np.zeros((len(pairs), 64), bool)
    steps = np.arange(width - 2, -1, -1).astype(np.uint64)
    for column in range(columns):
        if column and not column % LOOK:
            # the least distance in the column, from the lower end's and the steps up from there
            up = ((vp[:, None] >> steps) & one).astype(np.int8) - ((vn[:, None] >> steps) & one).astype(np.int8)
            least = score - np.maximum(np.cumsum(up, axis=1, dtype=np.int16).max(1, initial=0), 0)
            over = column >= n_b
            keep = ~over & ((least <= most) | (column + tau > n_a))
            if keep.sum() < 0.75 * len(keep):
                out[lanes[over]] = score[over]
                lanes, most, n_a, n_b, vp, vn, row, score, same, a = (x[keep] for x in (lanes, most, n_a, n_b, vp, vn, row, score, same, a))
                b = np.ascontiguousarray(b[:, keep])
                if not len(lanes):
                    return out
        now = b[column]
        np.equal(a[:, column : column + width], now[:, None], out=same[:, :width])
        pm = np.packbits(same, axis=1, bitorder="little").view("<u8")[:, 0]
        d0 = (((pm & vp) + vp) ^ vp | pm | vn) & mask
        hp, hn = (vn | ~(d0 | vp)) & mask, d0 & vp
        left = column + 1 + tau > n_a  # the last row has left the band's lower end
        row = np.where(left, row >> one, row)
        step = np.where(left, ((hp & row) != 0).astype(np.int64) - ((hn & row) != 0), (d0 & bottom) == 0)
        score = score + np.where(column < n_b, step, 0)
        slid = d0 >> one
        vp, vn = (hn | ~(slid | hp)) & mask, slid & hp
    out[lanes] = score
    return out


def letters(line: str) -> np.ndarray:
    """How often a line has the letters of each of 64 kinds."""
    return np.bincount(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) & 63, minlength=64).astype(np.int32)


def may_agree(a: str, b: str, tau: int) -> bool:
    """Whether the letters alone leave room for an edit distance of at most tau."""
    off = letters(a) - letters(b)
    return max(int(off[off > 0].sum()), -int(off[off < 0].sum())) <= tau


def agreeing(pairs: DataFrame, texts: DataFrame, sketches: DataFrame, budget: Budget) -> DataFrame:
    """The pairs (a, b) of nodes whose lines are within their budget of edits; sketches rule out most of the others before any text is dealt."""

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                (size_a, x), (size_b, y) = (sketch_column(batch.column(i)) for i in (2, 3))
                most = budget.of(np.minimum(size_a, size_b))
                near = np.nonzero(np.abs(size_a - size_b) <= most)[0]
                keep = pa.array(near[letters_allow(x, y, near, near, most[near])])
                yield pa.RecordBatch.from_arrays([batch.column(i).take(keep) for i in (0, 1)], names=["a", "b"])

    parts = shuffle_partitions(pairs)  # rows are few bytes and much work: Spark is not to lower the number of tasks
    told = pairs.join(sketches.toDF("a", "x"), "a").repartition(parts, "b").join(sketches.toDF("b", "y"), "b").select("a", "b", "x", "y")
    pairs = materialise(told.mapInArrow(possible, "a long, b long"), "possible")
    texts = materialise(texts_of(texts, pairs.select(F.explode(F.array("a", "b")).alias("node"))), "texts")
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").repartition(parts, "b").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    both = both.select("a", "b", "x", "y", budget.column(F.least(F.length("x"), F.length("y"))).alias("most"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, most = (batch.column(i).to_pylist() for i in (2, 3, 4))
            keep = within_all(list(zip(x, y)), most)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def sketches_of(lines: list[str]) -> list[bytes]:
    """Each line's length and how often it has the letters of each of 32 kinds, 255 at most (a cut never adds to a difference)."""
    sizes = np.array([len(t) for t in lines], dtype=np.int64)
    out = np.zeros((len(lines), 36), np.uint8)
    out[:, :4] = sizes.astype("<u4").view(np.uint8).reshape(-1, 4)
    for a, b in slices(sizes.tolist(), SKETCHED):
        kinds = np.frombuffer("".join(lines[a:b]).encode("utf-32-le", "surrogatepass"), np.uint32) & 31
        at = np.repeat(np.arange(b - a), sizes[a:b]) << 5
        out[a:b, 4:] = np.minimum(np.bincount(at + kinds, minlength=(b - a) << 5), 255).reshape(-1, 32)
    data = out.tobytes()
    return [data[i : i + 36] for i in range(0, len(data), 36)]


def sketched(texts: DataFrame) -> DataFrame:
    """(node, sketch) of ``texts(node, text)``, sketches as ``sketches_of`` has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sketches_of(b.column(1).to_pylist()), pa.binary())], names=["node", "sketch"])

    return texts.select("node", "text").mapInArrow(run, "node long, sketch binary")


def read_sketches(sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and counts [line, kind]."""
    rows = np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, 36)
    return np.ascontiguousarray(rows[:, :4]).view("<u4")[:, 0].astype(np.int64), rows[:, 4:].astype(np.int16)


def sketch_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``read_sketches`` of an Arrow column without nulls, from its buffer."""
    start, data = np.frombuffer(column.buffers()[1], np.int32, 1, 4 * column.offset)[0], column.buffers()[2]
    return read_sketches([memoryview(data)[start : start + 36 * len(column)]] if len(column) else [])


#: Pairs whose letters are compared at once; kinds of letters are compared in so many joint ones first.
COMPARED, JOINT = 16_384, 8


def letters_allow(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether letter counts leave room for ``most`` edits, for each pair of a row ``p`` of ``a`` and a row ``q`` of ``b``.

    Sums over joint kinds differ by no more than the kinds do, so they rule pairs out first.
    """
    out = np.zeros(len(p), bool)
    joint_a, joint_b = (np.ascontiguousarray(x.reshape(len(x), JOINT, -1).sum(2, dtype=np.int16)) for x in (a, b))
    total_a, total_b = (x.sum(1, dtype=np.int64) for x in (a, b))
    for start in range(0, len(p), COMPARED):
        at = np.arange(start, min(start + COMPARED, len(p)))
        more = np.abs(total_a[p[at]] - total_b[q[at]])  # of two sides' surplus the greater is half of both and their difference
        for x, y in ((joint_a, joint_b), (a, b)):
            left = np.abs(x[p[at]] - y[q[at]]).sum(1, dtype=np.int64) + more <= 2 * most[at]
            at, more = at[left], more[left]
        out[at] = True
    return out


def block_filter(budget: Budget):
    """What ``linking.promising`` needs to rule out lines by their sketches."""

    def make():
        def may_link(a: list[bytes], b: list[bytes], asked: np.ndarray) -> np.ndarray:
            (size_a, x), (size_b, y) = read_sketches(a), read_sketches(b)
            most = budget.of(np.minimum(size_a[:, None], size_b[None, :]))
            out = asked & (np.abs(size_a[:, None] - size_b[None, :]) <= most)
            i, j = np.nonzero(out)
            out[i, j] = letters_allow(x, y, i, j, most[i, j])
            return out

        return may_link

    return make


def block_checker(budget: Budget):
    """What ``linking.block_links`` needs to tell lines within their budget."""

    def make():
        def candidates(a: list[str], b: list[str]) -> list[tuple[int, int]]:
            size_a, size_b = (np.array([len(t) for t in side]) for side in (a, b))
            most = budget.of(np.minimum(size_a[:, None], size_b[None, :]))
            rows, columns = np.nonzero(np.abs(size_a[:, None] - size_b[None, :]) <= most)
            counts_a, counts_b = (np.stack([letters(t) for t in side]) for side in (a, b))
            off = np.concatenate([np.zeros(0, np.int64), *(np.abs(counts_a[rows[s : s + 16_384]] - counts_b[columns[s : s + 16_384]]).sum(1) for s in range(0, len(rows), 16_384))])
            likely = np.nonzero(off <= 2 * most[rows, columns])[0]
            order = likely[np.argsort(off[likely], kind="stable")]
            return list(zip(rows[order].tolist(), columns[order].tolist()))

        def check(pairs: list[tuple[str, str]]) -> list[bool]:
            return within_all(pairs, budget.of([min(len(x), len(y)) for x, y in pairs]).tolist())

        return (lambda text: text), candidates, check

    return make


def located_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, file, row, line_no, h1, h2) of every line that is not blank; lines lose the white space around them."""
    lines = located(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col("__file").alias("file"), F.col("__row").alias("row"), F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(WHITE))).filter("line <> ''")
    return lines.select("doc_id", "file", "row", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def classed_lines(docs: DataFrame, budget: Budget, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``located_lines`` with ``class_doc`` and ``class_line``, the place of their class's first line, and whether they are ``kept``."""
    spark = docs.sparkSession
    here = materialise(located_lines(docs, id_col, text_col), "lines")
    texts = docs.select(F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 << 15)
    packs = packed_keys(texts, budget, parts).repartitionById(parts, "part")
    met = materialise(meeting_lines(packs, budget), "met")
    buckets = materialise(met.filter("hub IS NOT NULL").select("hub", "node").unionByName(hub_members(met.filter("hub IS NULL"))).distinct(), "buckets")
    known = materialise(met_lines(texts, buckets.select("node").distinct()).withColumn("h2", second_hash()), "met_lines")
    told = materialise(one_each(known.select("node", "h2", "sketch"), "sketch"), "sketches")
    sketches, lines = told.select("node", "sketch"), known.select("node", "text")

    def rest(groups: DataFrame) -> DataFrame:
        left = materialise(promising(groups, sketches, block_filter(budget)), "left")
        return block_links(left, materialise(texts_of(lines, left.select("node")), "texts"), block_checker(budget))

    components, _ = near_classes(buckets, lambda pairs: agreeing(pairs, lines, sketches, budget), rest)
    # complements are in reverse order and leave nulls least, so the greatest place is the first and rows without an id come last
    place = F.struct(*(F.bitwise_not(F.col(c)).alias(c) for c in ("doc_id", "file", "row", "line_no")))
    firsts = here.groupBy("h1", "h2").agg(F.max(place).alias("first"))
    linked = materialise(components.join(told.select("node", "h2"), "node"), "linked")
    # few lines have a link to another one: of the rest no row is shuffled
    some = rows_for(here.withColumnRenamed("h1", "node"), linked).groupBy("node", "h2").agg(F.max(place).alias("first"))
    moved = linked.join(some, ["node", "h2"])
    moved = materialise(moved.select("node", "h2", "component", "first"), "moved")
    leads = moved.groupBy("component").agg(F.max("first").alias("lead"))
    moved = moved.join(leads, "component").select(F.col("node").alias("h1"), "h2", "lead")
    firsts = firsts.join(moved, ["h1", "h2"], "left").select("h1", "h2", F.coalesce("lead", "first").alias("first"))
    out = here.join(firsts, ["h1", "h2"])
    named = [F.bitwise_not(F.col(f"first.{c}")).alias(n) for c, n in (("doc_id", "class_doc"), ("line_no", "class_line"))]
    return out.select("doc_id", "file", "row", "line_no", *named, place.eqNullSafe(F.col("first")).alias("kept"))


def line_classes(docs: DataFrame, budget: Budget = BUDGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, class_doc, class_line, kept) of every line that is not blank.

    Two lines are linked if they are equal or within the ``budget`` of the shorter one; classes are the connected
    sets. class_doc and class_line name the first occurrence of a class by (doc_id, row, line_no), rows without an id
    last; kept is true there alone. Null and empty texts have no lines. Rows are told apart by where they are read
    from, not by their id: repeated rows and rows that share an id are rows of their own, of which the first keeps its
    line. An empty table gives an empty result; other columns are not read. doc_id must be an integer.
    """
    out = classed_lines(docs, budget, id_col, text_col)
    return out.select("doc_id", "line_no", "class_doc", "class_line", "kept")


def drop_repeated_lines(docs: DataFrame, budget: Budget = BUDGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every line after the first of its class taken out of the text; all rows and columns stay.

    Blank lines stay, and rows without a text are unchanged. Rows count as in :func:`line_classes`.
    """
    rows = located(docs)
    gone = classed_lines(rows, budget, id_col, text_col).filter(~F.col("kept")).groupBy(F.col("file").alias("__gf"), F.col("row").alias("__gr")).agg(F.collect_set("line_no").alias("__gone"))
    rows = rows.join(gone, (F.col("__file") == F.col("__gf")) & (F.col("__row") == F.col("__gr")), "left")
    rows = rows.withColumn("__lines", F.when(F.col("__gone").isNotNull(), F.split(text_col, "\n")))  # used twice below, so it stays a step of its own
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__gone")  # by a hash of the numbers: linear in a text's lines
    text = F.when(F.col("__lines").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(left, lambda i: F.get("__lines", i)), "\n"))
    return rows.select(*(text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
