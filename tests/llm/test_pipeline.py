"""The pipeline's stages against brute force, each on what the one before kept."""

import hashlib
import random

import public_tokenizers
from test_linking import brute_documents, brute_lines
from tokenizers import Tokenizer

import corpus_pipeline as P
from tessera.llm import decontam, langid
from tessera.llm.common import materialise, table

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_stages_on_a_table(spark):
    docs = table(spark, SF, "documents")
    before = rows_of(docs)
    names = [n for n, _ in P.STAGES]
    assert names == ["language ID", "line dedup", "MinHash near-dedup", "benchmark decontamination", "BPE encoding and decoding"]

    docs = materialise(P.STAGES[0][1](spark, docs, SF), "p")
    got = rows_of(docs)
    assert got.keys() == {d for d, r in before.items() if r["text"] and any(map(str.isalpha, r["text"]))}
    assert all({**r, "lang": before[d]["lang"]} == before[d] for d, r in got.items())

    before = got
    order = [r["doc_id"] for r in docs.select("doc_id").collect()]
    docs = materialise(P.STAGES[1][1](spark, docs, SF), "p")
    gone = {}
    for d, n, _, _, first, _ in brute_lines([(d, before[d]["text"]) for d in order]):
        if not first:
            gone.setdefault(d, set()).add(n)
    want = {}
    for d, r in before.items():
        text = "\n".join(x for n, x in enumerate(r["text"].split("\n")) if n not in gone.get(d, ()))
        if text.strip(" \n"):
            want[d] = {**r, "text": text, "n_chars": len(text)}
    assert rows_of(docs) == want

    before = want
    docs = materialise(P.STAGES[2][1](spark, docs, SF), "p")
    keeps = {d for d, _, _, k in brute_documents([(d, r["text"]) for d, r in before.items()], 5, 80) if k}
    assert rows_of(docs) == {d: r for d, r in before.items() if d in keeps}

    before = rows_of(docs)
    docs = materialise(P.STAGES[3][1](spark, docs, SF), "p")
    items = [decontam.fold(r["text"]) for r in table(spark, SF, "benchmark").collect()]
    assert rows_of(docs) == {d: r for d, r in before.items() if not any(i in decontam.fold(r["text"]) for i in items)}

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    before = rows_of(docs)
    out = rows_of(P.STAGES[4][1](spark, docs, SF))
    assert out.keys() == before.keys()
    for d, r in before.items():
        ids = library.encode(r["text"], add_special_tokens=False).ids
        assert out[d]["ids"] == ids and out[d]["n_tokens"] == len(ids)
        assert out[d]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert rows_of(P.run(spark, SF)) == out


def test_stages_on_odd_rows(spark):
    line = "a line of some length that comes again and again"
    rows = [(1, None, "en", "s", 0, 1), (2, "123", "en", "s", 3, 1), (3, line, "en", None, 4, 1), (None, line + "\nthe other line of it", None, "s", 4, 1), (4, line + "\nthe cat sat on the mat with the dog", "en", "s", 4, 1), (4, line, "en", "s", 4, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept int")
    for stage in (docs, docs.limit(0)):
        for name, f in P.STAGES[:-1]:
            stage = materialise(f(spark, stage, SF), "odd")
            assert stage.columns == docs.columns, name
        P.STAGES[-1][1](spark, stage, SF).collect()
    left = rows_of(P.STAGES[1][1](spark, P.STAGES[0][1](spark, docs, SF), SF))
    assert left.keys() == {3, 4, None} and left[4]["text"] == "the cat sat on the mat with the dog" and left[None]["text"] == "the other line of it"
    assert langid.UNDETERMINED not in {r["lang"] for r in left.values()}


def test_rows_without_an_id_and_rows_that_share_one(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice(("stone", "river", "field", "tree", "cloud", "house", "light", "road")) + str(rng.randrange(60)) for _ in range(n))
    a, b, c = prose(80), prose(80), prose(80)
    item = table(spark, SF, "benchmark").first()["text"]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    frame = lambda rows: spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], columns)
    texts = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)

    near = a.replace("stone1", "x", 1) + " end"
    got = texts(P.deduplicate_documents(spark, frame([(1, a), (1, a), (1, b), (2, near), (None, a), (None, c), (None, c), (3, "")]), SF))
    assert got == sorted([(1, a), (1, b), (None, c), (3, "")], key=repr)

    rows = [(1, a), (1, a + " " + item), (None, item), (None, b), (2, None)]
    assert texts(P.decontaminate(spark, frame(rows), SF)) == sorted([(1, a), (None, b), (2, None)], key=repr)

    rows = [(1, a + "\n" + b), (1, a + "\n" + b), (1, c), (None, c + "\n" + prose(9)), (None, a)]
    got = texts(P.deduplicate_lines(spark, frame(rows).coalesce(1), SF))
    assert got == sorted([(1, a + "\n" + b), (1, c), (None, rows[3][1].split("\n")[1])], key=repr)
