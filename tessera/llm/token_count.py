"""Token counts of a unigram tokenizer without its tokens: Viterbi over the vocabulary matches of an automaton.

An Aho-Corasick automaton lists the vocabulary pieces that end at each position, longest first, which is the order
of their starts. The dynamic program keeps for each position the best score and the number of pieces that gave it.
Ties follow the tokenizer: a later start only wins with a strictly greater score, a character that no piece matches
alone costs the lowest score less 10, and neighbouring unknowns count as one piece.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import Memo, map_text, resource

UNKNOWN_PENALTY = 10.0
SPACE = "▁"


def unigram_pieces(model_file: str, limit: int = 1_000_000) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece file, in id order; control and byte pieces are left out but for unknown."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    if sp.get_piece_size() > limit:
        raise ValueError(f"{model_file} has more than {limit} pieces")
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in ids]


class UnigramCounter:
    """Counts the pieces that a unigram model with white-space marks splits a text into."""

    def __init__(self, pieces: list[tuple[str, float]], unknown: str = "<unk>"):
        self.automaton = ahocorasick.Automaton()
        scores = dict(pieces)
        for piece, score in scores.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score, piece == unknown))
        self.automaton.make_automaton()
        self.unknown_score = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.chunks = Memo(self._chunk)

    def _chunk(self, chunk: str) -> int:
        return self.pieces(SPACE + chunk)

    def pieces(self, text: str) -> int:
        """Viterbi over one pre-token."""
        n = len(text)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        unknown, alone = [False] * (n + 1), [False] * (n + 1)
        arcs: list[list[tuple[int, float, bool]]] = [[] for _ in range(n + 1)]
        for at, (length, score, spelt) in self.automaton.iter(text):
            arcs[at + 1].append((at + 1 - length, score, spelt))
            if length == 1:
                alone[at + 1] = True
        lowest = self.unknown_score
        for i in range(1, n + 1):
            found = False
            for j, score, spelt in arcs[i]:
                total = score + best[j]
                if not found or total > best[i]:
                    found, best[i], unknown[i] = True, total, spelt
                    count[i] = count[j] + (not (spelt and unknown[j]))
            if not alone[i]:
                total = lowest + best[i - 1]
                if not found or total > best[i]:
                    best[i], unknown[i] = total, True
                    count[i] = count[i - 1] + (not unknown[i - 1])
        return count[n]

    def count(self, text: str) -> int:
        """Of a whole text: every blank starts a pre-token, and the first one gets a mark if it has none."""
        if not text:
            return 0
        return sum(map(self.chunks.__getitem__, (text[1:] if text[0] in (" ", SPACE) else text).replace(SPACE, " ").split(" ")))


def token_counts(docs: DataFrame, pieces: list[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_chars) for every input row, repeated rows included.

    Null and empty texts have no tokens. Texts are counted whole in time linear in their length. Null ids stay null;
    an empty table gives an empty result; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def make():
        counter = resource(f"unigram:{len(shared.value)}:{hash(tuple(shared.value[:4096]))}", lambda: UnigramCounter(shared.value))

        def f(columns, texts):
            return {"doc_id": columns[0], "n_tokens": pa.array(map(counter.count, texts), pa.int64()), "n_chars": pa.array(map(len, texts), pa.int64())}

        return f

    return map_text(docs.select(id_col, text_col), make, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, n_chars long", 1)
