"""What the n-gram join writes: columns and texts of documents that met, not all texts."""

import random

from tessera.llm import ngram_join as J
from tests.llm.test_ngram_join import brute


def test_texts_of_documents_that_met_alone_are_written(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(80))) for i in range(200)]
    rows += [(500, rows[3][1] + " end"), (3 + (1 << 25), rows[3][1]), (7 + (1 << 25), rows[7][1]), (600, rows[7][1] + " more")]  # ids that share a bit of the filter
    written = {}
    monkeypatch.setattr(J, "materialise", lambda df, name, f=J.materialise: written.setdefault(name, f(df, name)))
    got = J.similar_sets(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 5, 80)
    assert {3, 7, 500, 600} <= {r["node"] for r in written["texts"].collect()} <= {3, 7, 500, 600, 3 + (1 << 25), 7 + (1 << 25)}


def test_counters_of_a_task_are_small(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i} {j}" for j in range(300))) for i in range(100)], "doc_id long, text string").coalesce(1)
    found = J.sketches_and_counts(docs, "doc_id", "text", 5).filter("segment IS NOT NULL").select("segment", "counts")
    assert sum(len(r["counts"]) for r in found.collect()) < J.COUNTERS / 32
    order = J.column_order(found)
    assert len(order) == J.COUNTERS and set(order.tolist()) <= {0, 8, 12}
