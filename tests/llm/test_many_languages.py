"""Language identification with many letters: none may vanish."""

import random

import pytest

from tessera.llm import langid


@pytest.mark.parametrize("cells", (langid.DENSE_CELLS, 0))
def test_every_letter_of_the_samples_counts(monkeypatch, cells):
    monkeypatch.setattr(langid, "DENSE_CELLS", cells)
    rng = random.Random(7)
    first, second = [chr(0x4E00 + i) for i in range(400)], [chr(0x4E00 + 400 + i) for i in range(400)]
    samples = {"aa": "the cat and the dog sat there " * 200, "zh": "".join(rng.choice(first) for _ in range(3000)), "zz": "".join(rng.choice(second) for _ in range(3000))}
    parser = langid.CrossParser(samples)
    texts = [samples["zh"][100:160], samples["zz"][900:960], "".join(sorted(set(samples["zz"]))), "the dog"]
    langs, scores = parser.predict(texts)
    assert langs[:2] == ["zh", "zz"] and langs[3] == "aa" and min(scores[0], scores[1]) > 0.5
    assert all(parser.codes[ord(c)] > 2 for text in samples.values() for c in set(text) if c.isalpha())


def test_every_label_is_a_language(spark):
    rng = random.Random(8)
    rows = []
    for i in range(40):
        letters = [chr(0x3A00 + 10 * i + k) for k in range(10)]
        rows += [(100 * i + k, "".join(rng.choice(letters) for _ in range(60)), f"l{i:02d}") for k in range(3)]
    rows += [(None, "omega psi chi phi", "nn")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.identify(docs, langid.fit(docs), keep=("lang",)).collect()
    assert len(found) == len(rows) and all(r["lang"] == r["lang_pred"] for r in found)
