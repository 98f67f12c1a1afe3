"""Lines probe only the places where a shorter line's segment may be; what is known of hubs is not repeated for small ones."""

import random

import numpy as np
import pytest

from test_linking import FLAT, levenshtein, mutated

from tessera.llm import line_dedup as L
from tessera.llm import linking


def edited(rng, line, spots):
    """The line with one edit at each of the spots."""
    for at in sorted(spots, reverse=True):
        kind = rng.choice("idr")
        line = line[:at] + ("" if kind == "d" else rng.choice("xyz")) + line[at + (kind != "i") :]
    return line


@pytest.mark.parametrize("budget", [L.BUDGET, FLAT, L.Budget(share=60, slack=0)])
def test_pairs_with_all_edits_at_one_end_meet(budget):
    """Edits before, behind, in one segment or in all but one: the unchanged segment is moved as far as it may be."""
    rng = random.Random(11)
    pairs = []
    for _ in range(500):
        n = rng.choice((24, 49, 70, 99, 120, 200, 335, 700))
        a = "".join(rng.choice("abcdefgh ") for _ in range(n))
        t = int(budget.of(n))
        if not t:
            continue
        spared = rng.randrange(t + 1)
        ends = L.segments(n, t)
        spots = rng.choice([
            range(t), range(n - t, n), sorted(rng.sample(range(n), t)),
            [s + rng.randrange(size) for k, (s, size) in enumerate(ends) if k != spared],
            [ends[spared][0] + k for k in range(min(t, ends[spared][1]))],
        ])
        b = edited(rng, a, spots)
        if abs(len(a) - len(b)) <= (most := int(budget.of(min(len(a), len(b))))) and L.within(a, b, most):
            pairs.append((a, b))
    assert len(pairs) > 250
    lines = sorted({t for p in pairs for t in p})
    key, line, tag, place = L.line_keys(lines, budget)
    keys = [{} for _ in lines]
    for k in L.neighbours(key, tag, place, budget):
        for x, i, mark in zip(k.tolist(), line.tolist(), (tag >> 15).tolist()):
            keys[i][x] = keys[i].get(x, 0) | mark
    at = {t: i for i, t in enumerate(lines)}
    for a, b in pairs:
        x, y = keys[at[a]], keys[at[b]]
        assert any(x[k] | y[k] for k in x.keys() & y.keys()), (a, b)


def test_a_line_probes_few_of_its_substrings():
    """Every substring of 200 lines of 200 characters gave some 3,100 keys."""
    rng = random.Random(3)
    lines = ["".join(rng.choice("abcdefgh ") for _ in range(200)) for _ in range(200)]
    key, line, _, _ = L.line_keys(lines, L.BUDGET)
    assert len(set(line.tolist())) == 200 and len(key) < 2_000


def test_shortest_length_of_a_budget():
    for budget in (L.BUDGET, FLAT, L.Budget(share=60, slack=0), L.Budget(share=7, slack=11, tau=3, least=40)):
        of = budget.of(np.arange(4000))
        for t in range(1, int(of.max()) + 1):
            assert int(budget.shortest(np.array([t]))[0]) == int(np.argmax(of >= t))


def test_sketches_are_lengths_and_letters():
    lines = ["", "a", "über", "a" * 300, "the river \U0001f600", "z" * 70_000]
    for line, sketch in zip(lines, L.sketches_of(lines), strict=True):
        counts = np.minimum(L.letters(line).reshape(2, 32).sum(0), 255).astype(np.uint8)
        assert sketch == len(line).to_bytes(4, "little") + counts.tobytes()


def test_texts_that_are_not_asked_for_are_left_out_before_a_shuffle(spark):
    lines = spark.range(2000).selectExpr("id AS node", "concat('line ', id) AS text")
    lines = lines.unionByName(spark.createDataFrame([(7, "another line of one hash")], "node long, text string"))
    found = {r["node"]: r["text"] for r in L.texts_of(lines, spark.createDataFrame([(7,), (9,)], "node long")).collect()}
    assert set(found) == {7, 9} and found[9] == "line 9"
    first = L.one_each(lines.withColumn("h2", L.second_hash()), "text").filter("node = 7").first()
    assert found[7] == first["text"]  # the same of two lines of one hash wherever one is read


def test_small_hubs_are_one_share(spark, monkeypatch):
    monkeypatch.setattr(linking, "MANY", 100)
    buckets = spark.range(3, 33).selectExpr("id % 3 AS hub", "id AS node").unionByName(spark.range(3).selectExpr("id AS hub", "id AS node"))
    buckets = buckets.unionByName(spark.range(1000, 1200).selectExpr("1000L AS hub", "id AS node"))
    groups = linking.open_groups(buckets, spark.createDataFrame([(0, 0), (3, 0)], "node long, component long"))
    rows = groups.collect()
    assert {r["salt"] for r in rows if r["hub"] < 3} == {0} and len({r["salt"] for r in rows if r["hub"] == 1000}) > 10
    sizes = {(r["hub"], r["n_outside"], r["n_members"]) for r in rows}
    assert sizes == {(0, 9, 11), (1, 10, 11), (2, 10, 11), (1000, 199, 200)} and len(rows) == 233


def test_pairs_beyond_their_budget_are_given_up_without_losing_one(monkeypatch):
    rng = random.Random(2)
    pairs, taus = [], []
    for _ in range(300):
        a = "".join(rng.choice("abcd ") for _ in range(rng.choice((20, 40, 90, 150))))
        t = rng.randrange(1, 9)
        pairs.append((a, mutated(rng, a, rng.choice((0, 1, t, t, t + 1, 2 * t, 40)), "abcdx")))
        taus.append(t)
    want = [levenshtein(a, b) <= t for (a, b), t in zip(pairs, taus)]
    assert 50 < sum(want) < 250
    for look in (1, 5, 16, 1000):
        monkeypatch.setattr(L, "LOOK", look)
        monkeypatch.setattr(L, "LOOK_WIDE", look)
        assert L.within_all(pairs, taus) == want == [L.within(a, b, t) for (a, b), t in zip(pairs, taus)]


def test_unlike_lines_are_given_up_early(monkeypatch):
    """A pair of unlike long lines took a step for every column."""
    seen = []
    real = np.packbits
    monkeypatch.setattr(L.np, "packbits", lambda x, **how: (seen.append(len(x)), real(x, **how))[1])
    rng = random.Random(4)
    lines = ["".join(rng.choice("abcdefgh") for _ in range(1000)) for _ in range(20)]
    assert not any(L.within_all(list(zip(lines[::2], lines[1::2])), [20] * 10)) and len(seen) < 200


def test_small_blocks_are_looked_at_together():
    block = lambda hub, x, y: (hub, ([hub + i for i in range(x)], [1] * x, ["a"] * x), ([hub + i for i in range(y)], [2] * y, ["b"] * y))
    joint = list(linking.joint_blocks(iter([block(10, 2, 3), block(20, 1, 2), block(30, 5, 40), block(70, 1, 1)]), 60))
    assert [(x[0].tolist(), x[1].tolist(), x[7].tolist(), x[9]) for x in joint] == [
        ([10, 10, 20], [0, 0, 1], [10, 11, 12, 20, 21], ["b"] * 5), ([30] * 5, [0] * 5, list(range(30, 70)), ["b"] * 40), ([70], [0], [70], ["b"]),
    ]
