"""Runs of periodic words: against brute force, and the contract's digests."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tessera.llm import queries, runs
from tessera.llm.common import table

SF = "/root/testdata/sf0.001"


def brute(words, least=6, exponent=4):
    """(start, length, period) of every run, from the definition: for each period the maximal stretches that keep it."""
    found = {}
    n = len(words)
    every = np.array([{w: i for i, w in enumerate(dict.fromkeys(words))}[w] for w in words]) if n < 3000 else np.unique(np.array(words), return_inverse=True)[1]
    for q in range(1, n // exponent + 1):
        same = np.concatenate([[0], (every[q:] == every[:-q]).astype(np.int8), [0]])
        edge = np.diff(same)
        for a, b in zip(np.nonzero(edge > 0)[0].tolist(), np.nonzero(edge < 0)[0].tolist()):
            if b - a + q >= max(least, exponent * q):
                found.setdefault((a, b - a + q), q)  # periods come in order: the smallest stays
    return sorted((a, length, q) for (a, length), q in found.items())


def made(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def contract(doc_id, text):
    words = (text or "").encode().split()
    words = made(words, doc_id) if doc_id is not None else words
    found = brute(words)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    stay = b" ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{a},{n},{q}\n" for a, n, q in found)
    return (doc_id, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(stay).hexdigest())


@pytest.mark.parametrize("least,exponent", [(6, 4), (1, 2), (5, 3), (12, 2)])
def test_runs_against_brute_force(least, exponent):
    rng = random.Random(least)
    for _ in range(400):
        words = []
        while len(words) < rng.choice((0, 8, 30, 120)):
            part = [rng.randrange(rng.choice((1, 2, 3, 9))) for _ in range(rng.randint(1, 9))]
            words += part * rng.choice((1, 1, 2, 4, 5))
        assert [tuple(r) for r in runs.runs_of(words, least, exponent)] == brute(words, least, exponent), words


def test_repeated_words_that_no_k_gram_tells_apart():
    rng = random.Random(3)
    for _ in range(200):  # periods that hold each of their k-grams twice
        half = [rng.randrange(2) for _ in range(12)]
        words = (half + half + [rng.randrange(2)]) * 5
        assert [tuple(r) for r in runs.runs_of(words)] == brute(words)


def test_long_stretches():
    for words in ([7] * 30_000, list(range(3000)) * 8, ([1, 2] * 40 + [3]) * 300):
        assert [tuple(r) for r in runs.runs_of(words)] == (brute(words) if len(words) < 25_000 and words[0] == 1 else [(0, len(words), 1 if words[0] == 7 else 3000)])


def test_places_stay_in_order(monkeypatch):
    monkeypatch.setattr(runs, "SHARE", 8)
    rng, values = random.Random(1), list(range(0, 900, 3))
    rng.shuffle(values)
    places, known = runs.Places(values[0]), values[:1]
    for x in values[1:]:
        low, high = places.insert(x)
        assert low == max((k for k in known if k < x), default=None) and high == min((k for k in known if k > x), default=None)
        known.append(x)
    assert list(places) == sorted(values) and places.n == len(values)


def test_query_against_the_contract(spark):
    docs = table(spark, SF, "documents").collect()
    got = sorted(map(tuple, queries.op13_runs(spark, SF).collect()))
    assert got == sorted(contract(r["doc_id"], r["text"]) for r in docs)
    assert sum(r[1] for r in got) > 5


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a a a a a"), (5, "a a a a a a"), (6, "x a\tb  a b a b a\nb y"), (None, "a " * 9), (7, "z" * 500_000), (5, "a a a a a a"), (8, "é é " * 8)]
    df = spark.createDataFrame([(*r, 1, "r") for r in rows], "doc_id long, text string, period int, runs string")
    got = [tuple(r) for r in runs.summary(runs.periodic_runs(df)).collect()]
    unchanged = [(i, *contract(None, t)[1:]) for i, t in rows]
    assert sorted(got, key=repr) == sorted(unchanged, key=repr)
    assert [r[:6] for r in got if r[0] == 6] == [(6, 1, 1, 8, 2, 4000)]
    assert runs.summary(runs.periodic_runs(df.limit(0))).collect() == []
    texts = {r["doc_id"]: r["text"] for r in queries.made_periodic(df).collect()}
    assert all((texts[i] or "").split() == [w.decode() for w in made([w.encode() for w in (t or "").split()], i)] for i, t in rows if i not in (None, 8))
