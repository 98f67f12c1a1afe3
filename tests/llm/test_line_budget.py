"""A line budget that grows with the line, against every pair's edit distance."""

import random

import pytest

from test_linking import FLAT, components, levenshtein, mutated

from pyspark.sql import functions as F

from tessera.llm import line_dedup as L


@pytest.mark.parametrize("budget", [L.BUDGET, FLAT, L.Budget(share=60, slack=0)])
def test_grown_budget_against_every_pair(spark, budget):
    rng = random.Random(5)
    words = ["the", "river", "of", "stone", "and", "a", "quiet", "morning", "über", "field", "with", "seven"]
    lines = []
    for i in range(60):
        base = " ".join(rng.choice(words) for _ in range(rng.choice((3, 6, 12, 25, 60)))) + f" {i} end"
        most = int(budget.of(len(base)))
        lines += [base] + [mutated(rng, base, e, "xyz ") for e in (1, most // 2 + 1, most, most + 3)]
    lines = sorted({t.strip(L.WHITE) for t in lines})
    links = []
    for i, a in enumerate(lines):
        for b in lines[i + 1 :]:
            most = int(budget.of(min(len(a), len(b))))
            if most and abs(len(a) - len(b)) <= most and levenshtein(a, b) <= most:
                links.append((a, b))
                assert L.may_agree(a, b, levenshtein(a, b))
    assert len(links) > 100
    key, line, tag, place = L.line_keys(lines, budget)
    keys = [{} for _ in lines]
    for salted in L.neighbours(key, tag, place, budget):
        for k, i, mark in zip(salted.tolist(), line.tolist(), (tag >> 15).tolist()):
            keys[i][k] = keys[i].get(k, 0) | mark
    at = {t: i for i, t in enumerate(lines)}
    for a, b in links:  # each linked pair meets under a key, one of the two by a segment
        x, y = keys[at[a]], keys[at[b]]
        assert any(x[k] | y[k] for k in x.keys() & y.keys()), (a, b)
    if budget != L.BUDGET:
        return
    root = components(lines, links)
    first = {}
    for i, t in enumerate(lines):
        first.setdefault(root[t], i)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_doc"] for r in L.line_classes(docs, budget).collect()}
    assert got == {i: first[root[t]] for i, t in enumerate(lines)}


def test_budget_grows_smoothly(spark):
    most = L.BUDGET.of(range(5000))
    assert most[0] == 0 and set(most[1:] - most[:-1]) == {0, 1} and most[20] == 1 and most[4000] == 80
    column = spark.range(5000).select(L.BUDGET.column(F.col("id")).alias("b")).toArrow()["b"].to_pylist()
    assert column == most.tolist()
