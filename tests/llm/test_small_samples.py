"""Language identification where a label's sample is tiny: it takes no text of another language."""

import math
import random

import pytest

import corpus_pipeline
from tessera.llm import langid
from tessera.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def prose():
    """(samples of each language, texts with their language) of the table."""
    import pyarrow.parquet as pq

    rows = pq.read_table(f"{SF}/documents.parquet", columns=["text", "lang"]).to_pylist()
    rows = [r for r in rows if r["lang"] and r["text"] and len(r["text"]) > 200]
    samples = {}
    for r in rows[: len(rows) // 2]:
        samples[r["lang"]] = (samples.get(r["lang"], "") + "\n" + r["text"][:2400])[:24_000]
    return samples, [(r["text"][:2000], r["lang"]) for r in rows[len(rows) // 2 :]][:140]


def right(samples, texts):
    return sum(got == lang for got, (_, lang) in zip(langid.CrossParser(samples).predict([t for t, _ in texts])[0], texts)) / len(texts)


@pytest.mark.parametrize("tiny", ["ok", "xxx", "a", "etaoinshrd", "the", "e t a o i n s h r d l u"])
def test_a_tiny_sample_takes_no_text(prose, tiny):
    samples, texts = prose
    before = right(samples, texts)
    assert before >= 0.97 and right(samples | {"zz": tiny}, texts) >= before - 0.01
    assert langid.CrossParser(samples | {"zz": tiny}).predict([tiny])[0][0] in {"zz", *samples}


def test_a_sample_a_hundred_times_smaller(prose):
    samples, texts = prose
    before = {lang: right(samples, [t for t in texts if t[1] == lang]) for lang in samples}
    for small in samples:
        cut = samples | {small: samples[small][:240]}
        for lang in samples:
            own = right(cut, [t for t in texts if t[1] == lang])
            assert own >= before[lang] - (0.01 if lang != small else 0.1), (small, lang, own)


def test_predictions_against_their_definition():
    rng = random.Random(4)
    for _ in range(60):
        samples = {lang: "".join(rng.choice(letters) for _ in range(rng.choice((1, 6, 80)))) for lang, letters in (("a", "abc "), ("b", "bcd "), ("c", "äöü a"))}
        parser = langid.CrossParser(samples)
        text = "".join(rng.choice("abcdä öz") for _ in range(rng.randrange(60)))
        fold = lambda t: " " + " ".join("".join(c if c.isalpha() else " " for c in t).split())
        has = {k: fold(v) + (" " if not v[-1].isalpha() else "") for k, v in samples.items() if fold(v) != " "}
        known = {c for v in has.values() for c in v if c != " "}
        flat, cost = fold(text) + (" " if text and not text[-1].isalpha() else ""), {}
        if flat.strip():
            for lang, sample in has.items():
                at = phrases = 0
                while at < len(flat):
                    size = 1
                    while at + size < len(flat) and flat[at : at + size + 1] in sample and flat[at] in sample:
                        size += 1
                    phrases += flat[at] in known or flat[at] == " "
                    at += size
                cost[lang] = bool(set(flat) & known) * phrases * math.log2(len(sample) + len(known) + 1)
        got, score = parser.predict([text])
        if not cost:
            assert got == ["und"] and score == [0.0]
            continue
        low = min(cost.values())
        assert got[0] in [k for k, v in cost.items() if v <= low + 1e-9], (samples, text, cost)
        second = sorted(cost.values())[min(1, len(cost) - 1)]
        assert score[0] == pytest.approx((1 - low / second if second else 0.0) if len(cost) > 1 else 1.0, abs=1e-9)


def test_a_stray_label_changes_no_other_document(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    stray = docs.limit(1).selectExpr(*(f"CAST({ {'text': repr('ok'), 'lang': repr('xx'), 'doc_id': '900000'}.get(c, c) } AS {k}) AS {c}" for c, k in docs.dtypes))
    plain = {r["doc_id"]: r["lang"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    with_stray = {r["doc_id"]: r["lang"] for r in corpus_pipeline.identify_language(spark, docs.unionByName(stray), "").collect()}
    assert {i for i in plain if plain[i] != with_stray[i]} == set() and with_stray[900000] == "xx"


def test_blocks_of_items_are_separate_passes(spark):
    """However many blocks of items there are, a stage holds one block's automaton."""
    from tessera.llm import decontam

    docs = spark.createDataFrame([(i, f"some words before number {i} of the items and some after {i}") for i in range(30)] + [(None, None)], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"number {i} of the items") for i in range(12)], "item_id long, text string")
    whole = decontam.contaminated(docs, items)
    cut = decontam.contaminated(docs, items, at_once=40)
    assert sorted(map(str, cut.collect())) == sorted(map(str, whole.collect()))
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
