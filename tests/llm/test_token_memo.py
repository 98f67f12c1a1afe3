"""The library encoder's memo is bounded within a batch of texts too."""

import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import bpe, token_store


def test_memo_stays_bounded_within_a_batch(monkeypatch):
    monkeypatch.setattr(token_store, "MEMO_ENTRIES", 100)
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, library = token_store.LibraryEncoder(bpe.read_spec(path)), Tokenizer.from_file(str(path))
    library.no_truncation()
    library.no_padding()
    texts = [" ".join(f"Word{i}, don't{i}\nÄ{i}  <|{i} é{i}." for i in range(a, a + 700)) for a in (0, 350)] + ["", " "]
    ids, ends = encoder.encode(texts, 1)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [[*library.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert len(encoder.memo) <= 60 and len(encoder.memo.older) <= 60
