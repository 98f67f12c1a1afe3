"""Byte-pair encoding by a tokenization automaton.

The merges are compiled, in their order, into a deterministic automaton over tokens. Every arc that carries token
``t`` leads to one state, ``target[t]``. The automaton starts as one state with a loop for each base symbol. The
gadget of merge ``u v -> w``: the state behind ``u`` is split; all ``u`` arcs now lead to a copy without its ``v``
arc, and every state that had both steps gains a ``w`` arc to where ``v`` led. A token sequence is accepted exactly
when it is the encoding of what it spells. A split removes one arc, so a state is kept as a list of segments
(left token, merges before this rank), which states share; :meth:`MergeAutomaton.accepts` reads an arc from it and
keeps it in a transition table.

A pre-split word is encoded by one pass: each prefix has one accepted path, so for each end the table names the one
token that continues an accepted prefix. Decoding emits the arcs' labels.
"""

from __future__ import annotations

import json
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm.common import MEMO_ENTRIES, Memo, map_text, resource

ENDLESS = 1 << 60
#: Chunks a worker's memo holds at most.
CHUNKS = 600_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        out[b] = chr(b) if b in plain else chr(extra)
        extra += b not in plain
    return out


class MergeAutomaton:
    """Built from (left, right) merges in rank order and a token -> id vocabulary."""

    def __init__(self, merges: list[tuple[str, str]], vocab: dict[str, int]):
        self.vocab = dict(vocab)
        self.longest = max(map(len, vocab), default=1)
        #: gadget[u][v]: rank of the merge that took the v arc from the state behind u.
        self.gadget: dict[int, dict[int, int]] = {}
        #: target[t]: the state behind t, as segments (token, ranks below which its splits count).
        self.target: dict[int, tuple[tuple[int, int], ...]] = {}
        #: spine[t]: t and its left parts, each with the rank at which the arc of the next larger one was made.
        self.spine: dict[int, tuple[tuple[int, int], ...]] = {}
        for rank, (left, right) in enumerate(merges):
            u, v, w = (self.vocab.get(x) for x in (left, right, left + right))
            if u is None or v is None:  # of a token without arcs
                self.vocab.pop(left + right, None)
                continue
            for base in (u, v):
                self.target.setdefault(base, ((base, ENDLESS),))
                self.spine.setdefault(base, ((base, ENDLESS),))
            if not self._read(u << 32 | v):  # no state has both steps: the token has no arc
                self.vocab.pop(left + right)
                continue
            (_, _), *rest = self.target[v]
            self.target[w] = ((w, ENDLESS), (v, rank), *((t, min(k, rank)) for t, k in rest))
            (_, _), *lower = self.spine[u]
            self.spine[w] = ((w, ENDLESS), (u, rank), *((t, min(k, rank)) for t, k in lower))
            self.gadget.setdefault(u, {})[v] = rank
        for t in vocab.values():
            self.target.setdefault(t, ((t, ENDLESS),))
            self.spine.setdefault(t, ((t, ENDLESS),))
        self.table: dict[int, bool] = Memo(self._read)
        #: Of prefixes read so far: (state, symbol) -> state, and a state's last arc as (token, start).
        self.states: dict[int, int] = {}
        self.arcs: list[tuple[int, int]] = [(0, 0)]

    def _read(self, arc: int) -> bool:
        last, token = arc >> 32, arc & 0xFFFFFFFF
        for seen, before in self.target[last]:
            if splits := self.gadget.get(seen):
                for part, made in self.spine[token]:
                    k = splits.get(part)
                    if k is not None and k < before and k <= made:
                        return False
        return True

    def accepts(self, last: int, token: int) -> bool:
        """Whether the state behind ``last`` has an arc for ``token``."""
        return self.table[last << 32 | token]

    def _arc(self, symbols: str, last: list[int], i: int, tail: str) -> tuple[int, int]:
        """The one token that ends at ``i`` and continues an accepted prefix, and where it starts."""
        vocab, table = self.vocab, self.table
        for j in range(max(0, i - self.longest), i):
            t = vocab.get(symbols[j:i] + tail)
            if t is not None and (not j or table[last[j] << 32 | t]):
                return t, j
        raise ValueError(f"no token for {symbols[:i]!r}")

    def encode(self, symbols: str, end: str) -> tuple[int, ...]:
        """Ids of a word given by its base symbols; ``end`` is appended to the last one."""
        last, back, state = [0], [0], 0
        for i, c in enumerate(symbols[:-1], 1):  # prefixes read before are states of the table
            at = state << 16 | ord(c)
            state = self.states.get(at)
            if state is None:
                got = self._arc(symbols, last, i, "")
                if len(self.arcs) >= MEMO_ENTRIES:
                    return self._fresh(symbols, end)
                state = self.states[at] = len(self.arcs)
                self.arcs.append(got)
            else:
                got = self.arcs[state]
            last.append(got[0])
            back.append(got[1])
        n = len(symbols)
        t, n = self._arc(symbols, last, n, end)
        out = [t]
        while n:
            out.append(last[n])
            n = back[n]
        return tuple(reversed(out))

    def _fresh(self, symbols: str, end: str) -> tuple[int, ...]:
        """Empties the table of prefixes, which is bounded, and reads the word anew (a long word without it)."""
        self.states, self.arcs = {}, [(0, 0)]
        if len(symbols) < MEMO_ENTRIES // 4:
            return self.encode(symbols, end)
        last, back = [0], [0]
        for i in range(1, len(symbols) + 1):
            t, j = self._arc(symbols, last, i, end if i == len(symbols) else "")
            last.append(t)
            back.append(j)
        out, n = [], len(symbols)
        while n:
            out.append(last[n])
            n = back[n]
        return tuple(reversed(out))


def split_pattern(spec: dict):
    """findall() of a tokenizer file's pre-token pattern."""
    split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    return regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")).findall


def lowered(text: str, hints: set[str]) -> str:
    """Lower case where that is safe before the tokenizer's own normalisation: Latin-1 (no marks to compose), and no
    spelling that lower case might turn into a special token, which the raw text alone can hold."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    low = text.lower()
    return text if any(h in low for h in hints) else low


class BpeCodec:
    """A word-level BPE tokenizer file (lower case, white space dropped, words end in a mark) as an automaton."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model = spec["model"]
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = MergeAutomaton(pairs, model["vocab"])
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = {i: t for t, i in (*model["vocab"].items(), *self.special.items())}
        self.find = split_pattern(spec)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.hints = {s[:2] for s in self.special}
        self.symbols = byte_symbols()
        #: Of chunks without blanks; a pre-token is a chunk too.
        self.memo = Memo(self._chunk, CHUNKS)

    def _word(self, word: str) -> tuple[int, ...]:
        if word.isascii() and word.isalnum():  # these bytes stand for themselves
            return self.automaton.encode(word, self.end)
        return self.automaton.encode("".join(map(self.symbols.__getitem__, word.encode())), self.end)

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of a text without blanks and line feeds: nothing in an encoding reaches across those."""
        if chunk.isascii() and chunk.isalpha() and chunk.islower():
            return self._word(chunk)
        if self.at_special and any(h in chunk for h in self.hints):
            parts = self.at_special(chunk)
            if len(parts) > 1:
                return tuple(chain.from_iterable((self.special[p],) if p in self.special else self._chunk(p) for p in parts))
        text = chunk
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower() would look at a sigma's place
        words = self.find(text.lower())
        if len(words) == 1:
            return self._word(words[0]) if words[0] == chunk else self.memo[words[0]]
        return tuple(chain.from_iterable(map(self.memo.__getitem__, words)))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.memo.__getitem__, lowered(text, self.hints).replace("\n", " ").split(" "))))

    def decode(self, ids: list[int]) -> str:
        """Labels joined by blanks: what a tokenizer file without a decoder prescribes."""
        return " ".join(map(self.labels.__getitem__, ids))


def read_spec(path: str) -> str:
    """A tokenizer file's text, read on the driver; its size is checked, for it goes to every executor."""
    with open(path, encoding="utf-8") as f:
        spec = f.read(64 << 20)
        if f.read(1):
            raise ValueError(f"{path} is larger than 64 MB")
    return spec


def bpe_encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every whole text: (doc_id, ids array<int>, decoded string).

    One row per input row, duplicates included. Null and empty texts: no ids and an empty decoding. A null id stays
    null. Other columns are not read, whatever their names. Long texts are encoded whole, in time linear in their
    length. An empty table gives an empty result. Special tokens spelt in a text get their own ids, as the library
    does it.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer))

    def make():
        codec = resource(f"bpe:{hash(spec.value)}", lambda: BpeCodec(spec.value))

        def f(columns, texts):
            ids = [codec.encode(t) for t in texts]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=ends[-1])
            return {"doc_id": columns[0], "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), "decoded": pa.array(map(codec.decode, ids), pa.string())}

        return f

    kind = docs.schema[id_col].dataType.simpleString()
    return map_text(docs.select(id_col, text_col), make, f"doc_id {kind}, ids array<int>, decoded string", 1)
