"""N-gram Jaccard join: bounds are exact, results are those of all pairs."""

import random

import numpy as np
import pytest

from tessera.llm import ngram_join as J
from tessera.llm.common import table
from tests.llm.test_linking import components


def sets_of(text, words):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w)} if 0 < len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}


def brute(rows, words, threshold):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, set())
        sets[i] = sets_of(t, words)
    ids = [i for i in sets if i is not None]
    holders = {}
    for i in ids:
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    pairs = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    found = components(ids, links)
    return sorted(((i, len(sets_of(t, words)), None if i is None else found[i]) for i, t in rows), key=repr)


def chains(rng, n=300):
    """Texts that drift from each other word by word, copies, passages that many share, short and empty ones."""
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts, now = [None, "", " \t\n", "one", "One", "one two three", "A b c d e", "a B c d e"], []
    for i in range(n):
        if i % 40 == 0:
            now = [rng.choice(vocabulary) for _ in range(rng.choice((6, 30, 80, 200)))] + (passage if i % 80 == 0 else [])
        now = list(now)
        now[rng.randrange(len(now))] = rng.choice(vocabulary)
        texts.append(" ".join(now))
    return texts + texts[20:60] + [" ".join(passage), " ".join([*passage, "end"]), "x " * 5000]


@pytest.mark.parametrize("words,threshold", [(5, 80), (3, 60), (1, 95)])
def test_classes_against_all_pairs(spark, words, threshold):
    rng = random.Random(words)
    rows = list(enumerate(chains(rng)))
    rng.shuffle(rows)
    rows += [(None, "one two three"), (None, None), rows[0]]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, n int").repartition(3)
    got = [tuple(r) for r in J.similar_sets(df, words, threshold).collect()]
    assert sorted(got, key=repr) == brute(rows, words, threshold)


def test_classes_of_the_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    assert sorted((tuple(r) for r in J.similar_sets(docs).collect()), key=repr) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80)
    assert J.similar_sets(docs.limit(0)).collect() == []


def test_bounds_never_rule_out_a_link():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    sets = []
    for _ in range(60):
        n = int(rng.choice([1, 2, 5, 40, 900, 4000]))
        own = np.concatenate([base[: int(n * rng.uniform(0.6, 1))], rng.integers(0, 1 << 63, int(n * rng.uniform(0, 0.3)), dtype=np.uint64)])
        sets.append(np.unique(own if len(own) else base[:1]))
    linked = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))}
    assert set(J.linked_pairs(sets, sets, 80)) == linked
    marks = [(len(s), J.block_sizes(s)) for s in sets]
    marks[3] = marks[3][0], b""  # a set without block sizes is bounded by nothing but its size
    reach = J.may_reach_all(marks, marks, 80)
    for i, a in enumerate(marks):
        for j, b in enumerate(marks):
            assert reach[i, j] == J.may_reach(*a, *b, 80)
            assert reach[i, j] or (i, j) not in linked
    assert reach.sum() < 0.5 * reach.size
    order = rng.integers(1, 50, J.COUNTERS).astype(np.uint8)
    firsts = [set(J.first_columns(s, order, 80).tolist()) for s in sets]
    assert all(firsts[i] & firsts[j] for i, j in linked)


def test_long_products_go_through_many_column_blocks(monkeypatch):
    monkeypatch.setattr(J, "BLOCK_SHINGLES", 64)
    test_bounds_never_rule_out_a_link()
