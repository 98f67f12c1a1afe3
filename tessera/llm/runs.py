"""Runs of periodic words: stretches that repeat a shorter stretch several times over.

A suffix automaton of a text's words has a state for each set of stretches that end at the same places. Going up its
suffix links, the places of longer states merge into shorter ones, small sets into large ones; where two places become
neighbours and lie no further apart than the state's stretches are long, the stretch and its next occurrence touch or
overlap: a square with their distance as period. A square is extended word by word to the run that holds it. Every run
shows up so: at the state where a place of its last words meets the place one period on, no other lies between, or the
period would not be the smallest.

Words of a long run repeat close by. So before an automaton is built, a text is cut to the stretches whose k-grams all
occur more than once in it, with the largest k for which every run, from its first word to its last, lies in such a
stretch (``guaranteed``); in most texts nothing is left.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_text

#: Places of a set's share: inserting moves at most this many.
SHARE = 2048


class Run(NamedTuple):
    start: int
    length: int
    period: int


class Places:
    """An ordered set of whole numbers in shares of bounded size."""

    __slots__ = ("heads", "shares", "n")

    def __init__(self, first: int):
        self.heads, self.shares, self.n = [first], [[first]], 1

    def __iter__(self) -> Iterator[int]:
        for share in self.shares:
            yield from share

    def insert(self, x: int) -> tuple[int | None, int | None]:
        """Adds ``x`` and gives its neighbours."""
        heads, shares = self.heads, self.shares
        k = bisect_right(heads, x) - 1
        if k < 0:
            k = 0
        share = shares[k]
        i = bisect_left(share, x)
        low = share[i - 1] if i else None  # only the first share can lack one below
        high = share[i] if i < len(share) else heads[k + 1] if k + 1 < len(heads) else None
        share.insert(i, x)
        self.n += 1
        if not i:
            heads[k] = x
        if len(share) > SHARE:
            half = len(share) // 2
            shares.insert(k + 1, share[half:])
            heads.insert(k + 1, share[half])
            del share[half:]
        return low, high


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The suffix automaton's states: length of the longest stretch, suffix link, and the place of a prefix (-1: a copy)."""
    longest, link, place, following = [0], [-1], [-1], [{}]
    last = 0
    for at, w in enumerate(words):
        new = len(longest)
        longest.append(longest[last] + 1)
        link.append(0)
        place.append(at)
        following.append({})
        p = last
        while p >= 0 and w not in following[p]:
            following[p][w] = new
            p = link[p]
        if p >= 0:
            q = following[p][w]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                copy = len(longest)
                longest.append(longest[p] + 1)
                link.append(link[q])
                place.append(-1)
                following.append(dict(following[q]))
                while p >= 0 and following[p].get(w) == q:
                    following[p][w] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return longest, link, place


def squares(words: list[int]) -> Iterator[tuple[int, int]]:
    """(place, distance): a square of period ``distance`` ends at ``place``; at least one of each run."""
    longest, link, place = automaton(words)
    order = np.argsort(-np.array(longest), kind="stable").tolist()
    sets: list[Places | None] = [Places(p) if p >= 0 else None for p in place]
    for state in order:
        up, own = link[state], sets[state]
        if up <= 0:  # of no length: nothing is a square
            sets[state] = None
            continue
        to, most = sets[up], longest[up]
        sets[state] = None
        if to is None:
            sets[up] = own
            continue
        if own.n > to.n:
            own, to = to, own
        for x in own:
            low, high = to.insert(x)
            if low is not None and x - low <= most:
                yield x, x - low
            if high is not None and high - x <= most:
                yield high, high - x
        sets[up] = to


def extended(words: np.ndarray, end: int, period: int) -> tuple[int, int]:
    """(first, last) word of the run that holds the square of ``period`` which ends at ``end``."""
    n, step, right = len(words), 64, end
    while right + 1 < n:
        stop = min(n, right + 1 + step)
        differ = np.nonzero(words[right + 1 : stop] != words[right + 1 - period : stop - period])[0]
        if len(differ):
            right += int(differ[0])
            break
        right, step = stop - 1, 2 * step
    step, left = 64, end - 2 * period + 1
    while left > 0:
        stop = max(0, left - step)
        differ = np.nonzero(words[stop:left] != words[stop + period : left + period])[0]
        if len(differ):
            left = stop + int(differ[-1]) + 1
            break
        left, step = stop, 2 * step
    return left, right


def guaranteed(least: int, exponent: int) -> int:
    """The largest k such that each k-gram of a run has an equal one a period before or after it within the run."""
    return max(1, min(max(least, exponent * q) - 2 * q + 1 for q in range(1, least + 1)))


def repeated_stretches(words: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches of which every k-gram occurs more than once in ``words``."""
    if len(words) <= k:
        return []
    grams = np.lib.stride_tricks.sliding_window_view(words, k)
    mixed = np.zeros(len(grams), dtype=np.uint64)
    for i in range(k):  # equal k-grams are equal here; others that are too only make a stretch longer
        mixed = (mixed ^ grams[:, i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    equal = mixed[order][1:] == mixed[order][:-1]
    again = np.zeros(len(grams) + 2, dtype=np.int8)
    again[order[1:][equal] + 1] = again[order[:-1][equal] + 1] = 1
    edge = np.diff(again)
    return list(zip(np.nonzero(edge > 0)[0].tolist(), (np.nonzero(edge < 0)[0] + k - 1).tolist()))


def runs_of(words: list[int], least: int = 6, exponent: int = 4) -> list[Run]:
    """All runs of at least ``least`` words and ``exponent`` periods, by start, then period."""
    every = np.array(words, dtype=np.int64)
    out = []
    for a, b in repeated_stretches(every, guaranteed(least, exponent)):
        part = every[a:b]
        known: dict[int, tuple[list[int], list[int]]] = {}  # period -> starts and ends of its runs, in order
        best: dict[tuple[int, int], int] = {}
        for end, period in squares(part.tolist()):
            starts, ends = known.setdefault(period, ([], []))
            i = bisect_right(starts, end - 2 * period + 1)
            if i and ends[i - 1] >= end:
                continue
            left, right = extended(part, end, period)
            starts.insert(i, left)
            ends.insert(i, right)
            if right - left + 1 >= max(least, exponent * period):
                best[left, right] = min(period, best.get((left, right), period))
        out += [Run(a + left, right - left + 1, period) for (left, right), period in best.items()]
    return sorted(out, key=lambda r: (r.start, r.period))


def collapsed(n: int, runs: list[Run]) -> list[int]:
    """The words that stay: of every run its first period only."""
    gone = np.zeros(n + 1, dtype=np.int64)
    for r in runs:
        gone[r.start + r.period] += 1
        gone[r.start + r.length] -= 1
    return np.nonzero(np.cumsum(gone[:n]) == 0)[0].tolist()


def periodic_runs(docs: DataFrame, least: int = 6, exponent: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs array<struct<start, length, period>>, collapsed string) of every input row.

    Words are what stands between ASCII white space, numbered from 0. A run is a stretch of at least ``least`` words and
    ``exponent`` (2 or more) times its smallest period, the same words a period apart, that neither neighbour extends.
    ``collapsed`` joins by a blank the words that no run holds after its first period. Null and empty texts have no
    words, no runs and an empty ``collapsed``; repeated rows give repeated rows; an empty table gives an empty result;
    other columns are not read. A text is read whole, by one task: its automaton takes memory as its repeated stretches
    are long, some 1 KB for each of their words.
    """

    def make():
        def f(columns, texts):
            found, left, sizes = [], [], []
            for t in texts:
                words = t.encode("utf-8", "surrogatepass").split()
                number: dict[bytes, int] = {}
                runs = runs_of([number.setdefault(w, len(number)) for w in words], least, exponent)
                stay = collapsed(len(words), runs) if runs else range(len(words))
                found.append([r._asdict() for r in runs])
                left.append(b" ".join(words[i] for i in stay))
                sizes.append(len(words))
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in Run._fields]))
            return {"doc_id": columns[0], "n_words": pa.array(sizes, pa.int64()), "runs": pa.array(found, kind), "collapsed": pa.array(left, pa.binary()).cast(pa.string())}

        return f

    return map_text(docs.select(id_col, text_col), make, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string", 1)


def summary(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of ``periodic_runs``."""
    # lengths over periods are compared as whole numbers: of two runs a * d > b * c
    better = lambda a, b: F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    rows = found.withColumn("best", F.aggregate("runs", none, better))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    milli = F.expr("1000 * best.length DIV best.period")
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
