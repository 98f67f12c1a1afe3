"""Tokenizers: the automaton, the store and the counts against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from tessera.llm import bpe, queries, token_count, token_store
from tessera.llm.common import shared_path, table

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
LETTERS = "abcdefghijklmnopqrstuvwxyz  '0123456789.,!?$%&é ñÉßçΣσİıſKﬁ日本語́\t\n\r  \x1c\x01😀👍JΑΒ̌thethinringaaa"


def fuzz(n, letters=LETTERS, seed=1, longest=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(n)]


ODD = ["", " ", "\n", "x<|endoftext|>y <|startoftext|>", "A <|EndOfText|> B<|ENDOFTEXT|>c <|endoftext|>", "É<|EndOfText|>", "<|endoftext|", "It's we'RE they'll I'd", *("a" * n for n in range(1, 50)), "!" * 300, "ab" * 20_000, "J̌ǰ", "ªº µ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


def test_automaton_encodes_and_decodes_as_the_library(library):
    codec = bpe.BpeCodec(bpe.read_spec(WORDS))
    for text in fuzz(3000) + ODD:
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_automaton_of_small_merge_tables():
    """All short words over two letters, for random merge lists, against merging by rank."""
    rng = random.Random(4)

    def by_rank(word, ranks):
        parts = list(word)
        while True:
            at = min((ranks[p] for p in zip(parts, parts[1:]) if p in ranks), default=None)
            if at is None:
                return parts
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and ranks.get((parts[i], parts[i + 1])) == at:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out

    for _ in range(40):
        tokens, merges = ["a", "b"], []
        while len(merges) < 7:
            pair = rng.choice(tokens), rng.choice(tokens)
            if pair not in merges and pair[0] + pair[1] not in tokens:
                merges.append(pair)
                tokens.append(pair[0] + pair[1])
        vocab = {t: i for i, t in enumerate(tokens)}
        automaton = bpe.MergeAutomaton(merges, vocab)
        ranks = {p: i for i, p in enumerate(merges)}
        for n in range(1, 9):
            for bits in range(2**n):
                word = "".join("ab"[bits >> i & 1] for i in range(n))
                assert [tokens[i] for i in automaton.encode(word, "")] == by_rank(word, ranks), (merges, word)


def test_memo_of_prefixes_starts_anew_when_full(monkeypatch):
    codec = bpe.BpeCodec(bpe.read_spec(WORDS))
    texts = fuzz(400, "abcdefgh")
    want = [codec.encode(t) for t in texts]
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 60)
    small = bpe.BpeCodec(bpe.read_spec(WORDS))
    assert [small.encode(t) for t in texts] == want


def test_bpe_query_on_nulls_repeats_and_clashing_names(spark, library):
    rows = [(1, None, 0, "x"), (2, "", 0, "x"), (None, "abc", 0, "x"), (3, "ab " * 50_000, 0, "x"), (3, "ab " * 50_000, 0, "x"), (4, "<|endoftext|>Hi", 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string")
    got = bpe.bpe_encode_decode(docs, WORDS).collect()
    assert sorted((r["doc_id"] or 0, r["ids"], r["decoded"]) for r in got) == sorted((a or 0, e := library.encode(t or "", add_special_tokens=False).ids, library.decode(e, skip_special_tokens=False)) for a, t, *_ in rows)
    assert bpe.bpe_encode_decode(docs.limit(0), WORDS).count() == 0


def test_bpe_query_on_a_table(spark, library):
    want = {}
    for r in table(spark, SF, "documents").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        want[r["doc_id"]] = (len(ids), *digests)
    assert {r["doc_id"]: tuple(r)[1:] for r in queries.op5_bpe(spark, SF).collect()} == want


def test_library_memo_is_the_library(library, monkeypatch):
    monkeypatch.setattr(token_store, "MEMO_ENTRIES", 500)
    encoder = token_store.LibraryEncoder(bpe.read_spec(WORDS))
    texts = fuzz(2000) + ODD
    for a in range(0, len(texts), 97):
        flat, ends = encoder.encode(texts[a : a + 97], 1)
        for i, t in enumerate(texts[a : a + 97]):
            assert flat[ends[i] : ends[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids + [1]


def test_token_store_round_trip(spark, library):
    rng = random.Random(9)
    rows = [(i, t, 5) for i, t in enumerate(fuzz(300, seed=3))] + [(400, None, 1), (401, "", 1), (402, "word " * 30_000, 1), (7, "again", 1), (7, "again", 1)]
    rng.shuffle(rows)
    path = shared_path(spark, "store")
    token_store.write_tokens(spark.createDataFrame(rows, "doc_id long, text string, part int"), path, WORDS, parts=5)
    got = token_store.with_start(token_store.read_tokens(spark, path), path).orderBy("start").collect()
    ids = [i for r in got for i in r["ids"]]
    assert [r["doc_id"] for r in got] == sorted(r[0] for r in rows)
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    assert sorted((r["doc_id"], tuple(r["ids"])) for r in got) == sorted((d, (*library.encode(t or "", add_special_tokens=False).ids, 1)) for d, t, _ in rows)
    assert len(ids) == sum(r["n_tokens"] for r in got)
    assert token_store.read_tokens(spark, path, "doc_id", "n_tokens").columns == ["doc_id", "n_tokens"]


def test_token_store_of_an_empty_table(spark):
    path = shared_path(spark, "store")
    token_store.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, WORDS)
    assert token_store.with_start(token_store.with_crc32(token_store.read_tokens(spark, path)), path).count() == 0


def test_token_output_query(spark, library):
    want, start = {}, 0
    for r in sorted(table(spark, SF, "documents").collect(), key=lambda r: r["doc_id"]):
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want[r["doc_id"]] = (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op7_token_output(spark, SF).collect()} == want


def unigram(pieces):
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=False))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


def test_counts_follow_the_tokenizers_ties():
    """Few letters and whole-number scores: many paths tie."""
    rng = random.Random(6)
    letters = "ab▁c"
    for _ in range(60):
        pieces = {"<unk>": 0.0} | {"".join(rng.choice(letters) for _ in range(rng.randint(1, 4))): -float(rng.randint(1, 4)) for _ in range(9)}
        t, c = unigram(list(pieces.items())), token_count.UnigramCounter(list(pieces.items()))
        for text in fuzz(60, "ab c☃▁\n", seed=rng.random(), longest=14) + ["a<unk><unk>b ☃<unk>"]:
            assert c.count(text) == len(t.encode(text, add_special_tokens=False).ids), (pieces, text)


def test_counts_of_the_public_vocabulary(spark):
    pieces = token_count.unigram_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    t = unigram(pieces)
    rows = [(i, x) for i, x in enumerate(fuzz(300) + ["", None, "a" * 20_000, "a b  c"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_tokens"], r["n_chars"]) for r in token_count.token_counts(docs, pieces).collect()}
    assert got == {i: (len(t.encode(x or "", add_special_tokens=False).ids), len(x or "")) for i, x in rows}
    whole = {r["doc_id"]: r["n_tokens"] for r in queries.op6_token_count(spark, SF).collect()}
    assert whole == {r["doc_id"]: len(t.encode(r["text"] or "", add_special_tokens=False).ids) for r in table(spark, SF, "documents").collect()}


def test_count_cases(spark):
    pieces = token_count.unigram_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    t = unigram(pieces)
    rows = [(1, "a word", 5), (1, "a word", 5), (None, "another one", 6), (None, None, 7), (2, "x" * 50_000 + " tail", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = [(r["doc_id"], r["n_tokens"], r["n_chars"]) for r in token_count.token_counts(docs, pieces).collect()]
    assert sorted(got, key=repr) == sorted(((d, len(t.encode(x or "", add_special_tokens=False).ids), len(x or "")) for d, x, _ in rows), key=repr)
    assert token_count.token_counts(docs.limit(0), pieces).count() == 0


def test_token_files_allow_selective_reads(spark):
    import glob

    import pyarrow.parquet as pq

    path = shared_path(spark, "store")
    rows = [(i, " ".join(fuzz(400, seed=i))) for i in range(40)]
    token_store.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, WORDS, row_group_mb=1, page_kb=4, parts=1)
    (file,) = glob.glob(path.removeprefix("file://") + "/tokens/*.parquet")
    meta = pq.ParquetFile(file).metadata
    seen = 0
    for g in range(meta.num_row_groups):
        for c in range(meta.num_columns):
            column = meta.row_group(g).column(c)
            assert "DELTA_BINARY_PACKED" in column.encodings and column.has_column_index and column.has_offset_index
            seen += column.path_in_schema.startswith("ids")
        assert meta.row_group(g).total_byte_size <= 3 << 20
    assert seen == meta.num_row_groups >= 1
    # counts are read without the ids, and rows of one document without the others' row groups
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan(token_store.read_tokens(spark, path, "doc_id", "n_tokens")).split("ReadSchema")[1]
    one = token_store.read_tokens(spark, path).filter("doc_id = 7")
    assert "EqualTo(doc_id,7)" in plan(one) and one.count() == 1
