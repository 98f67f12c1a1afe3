"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text gives the longest match that starts at a position. A text is
parsed greedily into longest matches (a character that the language never has is a phrase of its own). A phrase says
where in the sample it stands, or which letter it is: of a sample of n characters and a joint alphabet of a letters, it
costs log2(n + a) bits, as if every sample began with one copy of the alphabet. The language where the phrases cost least
wins: a larger sample has longer matches and dearer phrases, and a tiny one, whose phrases are single letters, pays for
each what any letter costs. Letters that no sample has cost the same in every language and are left out. Texts are folded to
lower-case letters with single blanks, so that markup and digits carry no weight, and parsed whole: all texts of a
batch and all languages advance by one character at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import map_text, release

#: Default bounds of what a model is fitted on: rows and characters for each language, and characters of one row.
SAMPLE_ROWS, SAMPLE_CHARS, ROW_CHARS = 200, 24_000, 2_400
#: Cells of the transition table that a worker holds; larger automata look their arcs up by bisection.
DENSE_CELLS = 32_000_000
#: Characters of texts that are parsed side by side, and steps whose letters are laid out at once.
PARSED_CHARS, STEPS = 16_000_000, 128
UNDETERMINED = "und"


def suffix_arcs(codes: list[int]) -> list[dict[int, int]]:
    """{code: next state} for each state of the suffix automaton of ``codes``; state 0 is the root."""
    nexts, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        cur = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p != -1:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nexts


def suffix_automaton(codes: list[int], width: int) -> np.ndarray:
    """Transitions [state, code] of the suffix automaton of ``codes``; state 0 is the root, -1 no transition."""
    return Arcs([suffix_arcs(codes)], width).table().reshape(-1, width)


class Arcs:
    """The arcs of automata side by side, sorted by state x ``width`` + code: small however wide the alphabet is."""

    def __init__(self, automata: list[list[dict[int, int]]], width: int):
        self.roots = np.cumsum([0, *map(len, automata)])[:-1].astype(np.int64)
        at, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for root, nexts in zip(self.roots.tolist(), automata):
            at.append(np.array([(root + s) * width + c for s, arcs in enumerate(nexts) for c in arcs], dtype=np.int64))
            to.append(np.array([root + t for arcs in nexts for t in arcs.values()], dtype=np.int32))
        at, to = np.concatenate(at), np.concatenate(to)
        order = np.argsort(at)
        self.at, self.to, self.width, self.cells = at[order], to[order], width, sum(map(len, automata)) * width

    def table(self) -> np.ndarray:
        out = np.full(self.cells, -1, dtype=np.int32)
        out[self.at] = self.to
        return out

    def find(self, at: np.ndarray) -> np.ndarray:
        """Like indexing ``table()``."""
        if not len(self.at):
            return np.full(at.shape, -1, dtype=np.int32)
        i = np.minimum(np.searchsorted(self.at, at), len(self.at) - 1)
        return np.where(self.at[i] == at, self.to[i], np.int32(-1))


def letter_table() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


class CrossParser:
    """Fitted on {language: sample text}; languages whose sample has no letters cannot be told and are left out."""

    def __init__(self, samples: dict[str, str]):
        self.letters = letter_table()
        folded = {lang: points for lang in sorted(samples) if len(points := self.fold(samples[lang])[0])}
        self.langs = list(folded)
        known = [int(p) for p in np.unique(np.concatenate([np.zeros(0, np.uint32), *folded.values()])) if p != 32]
        #: What a phrase weighs in each language: a place in its sample, or a letter of any.
        self.weight = np.log2([len(p) + len(known) + 1 for p in folded.values()])
        #: Codes of all letters seen: 0 pads, 1 letter of no sample, 2 blank.
        self.codes = np.ones(0x110000, dtype=np.int32)
        self.codes[32] = 2
        self.codes[known] = np.arange(3, 3 + len(known))
        self.arcs = Arcs([suffix_arcs(self.codes[p].tolist()) for p in folded.values()], 3 + len(known))
        self.dense: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"dense": None}

    def lookup(self):
        """Next states by state x width + code: from a table if it is small enough."""
        if self.arcs.cells > DENSE_CELLS:
            return self.arcs.find
        if self.dense is None:
            self.dense = self.arcs.table()
        return self.dense.__getitem__

    def fold(self, text: str) -> tuple[np.ndarray, int]:
        """Code points of lower-cased letters after a blank, runs of all else as one blank; the number of letters."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
        letters = self.letters[points]
        points = np.where(letters, points, np.uint32(32))
        keep = letters.copy()
        keep[1:] |= letters[:-1]  # a blank stays where a letter stands before it
        return np.concatenate([np.full(1, 32, np.uint32), points[keep]]) if letters.any() else points[:0], int(letters.sum())

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases [text, language] but for letters of no sample, characters parsed and letters of each text; none where no sample has a letter of the text."""
        folded = [self.fold(t) for t in texts]
        sizes = np.array([len(p) for p, _ in folded], dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")  # texts that go on stand in front
        falling = -sizes[order]
        find, width = self.lookup(), self.arcs.width
        roots = self.arcs.roots[:, None]
        first = find(roots * width + np.arange(width)) if self.langs else np.zeros((0, width), np.int32)
        again = np.where(first < 0, roots, first).astype(np.int64)  # after a phrase ends before a letter
        state = np.repeat(roots, len(texts), axis=1)
        counts = np.zeros(state.shape, dtype=np.int64)
        for start in range(0, int(sizes.max(initial=0)), STEPS):
            m = int(np.searchsorted(falling, -start))
            grid = np.zeros((m, STEPS), dtype=np.int32)
            for lane, t in enumerate(order[:m].tolist()):
                part = folded[t][0][start : start + STEPS]
                grid[lane, : len(part)] = self.codes[part]
            now, told = state[:, :m], counts[:, :m]
            for row in np.ascontiguousarray(grid.T):
                to = find(now * width + row)
                stuck = to < 0
                told += (stuck | (now == roots)) & (row > 1)
                now = np.where(stuck, again[:, row], to).astype(np.int64)
            state[:, :m] = now
        out = np.zeros((len(texts), len(self.langs)), dtype=np.int64)
        out[order] = counts.T
        out[[not (self.codes[p] > 2).any() for p, _ in folded]] = 0  # blanks alone tell nothing
        return out, sizes, np.array([n for _, n in folded], dtype=np.int64)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and score: by how much, relative to the second best, the winner's cross entropy is less."""
        if not texts:
            return [], []
        counts, _, letters = self.phrases(texts)
        if not self.langs:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        cost = counts * self.weight
        order = np.argsort(cost, axis=1, kind="stable")
        best = cost[np.arange(len(texts)), order[:, 0]]
        second = cost[np.arange(len(texts)), order[:, min(1, len(self.langs) - 1)]]
        score = np.where((letters > 0) & (second > 0), 1 - best / np.maximum(second, 1e-9), 0.0) if len(self.langs) > 1 else (letters > 0).astype(float)
        return [self.langs[o] if n else UNDETERMINED for o, n in zip(order[:, 0], letters)], score.tolist()


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS, row_chars: int = ROW_CHARS) -> CrossParser:
    """Fits on a bounded sample of rows with a language and a text: the first of each language in hash order of (id, text).

    Every label found is a language. Rows without an id and rows that share one are sampled like all others.

    Two scans: one finds the hash below which about ``sample_rows`` rows of a language lie, one reads those rows. What
    the driver gets is bounded by languages x 2 ``sample_rows`` texts of ``row_chars`` characters, of which the model
    takes ``sample_chars`` for each language.
    """
    buckets = 1 << 30
    at = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(buckets))
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = labelled.groupBy(F.col(lang_col).alias("l")).agg(F.count("*").alias("n"), F.min(at).alias("least")).collect()
    below = {r["l"]: max(r["least"] + 1, sample_rows * buckets // r["n"] + 1) for r in sizes}
    rows = []
    if sizes:
        bounds = docs.sparkSession.createDataFrame(list(below.items()), f"__l {dict(docs.dtypes)[lang_col]}, __below long")
        chosen = labelled.select(F.col(lang_col).alias("lang"), at.alias("at"), F.substring(F.col(text_col), 1, row_chars).alias("sample"))
        chosen = chosen.join(F.broadcast(bounds), F.col("lang") == F.col("__l")).filter(F.col("at") < F.col("__below"))
        place = F.row_number().over(W.partitionBy("lang").orderBy("at", "sample"))
        rows = chosen.withColumn("place", place).filter(F.col("place") <= 2 * sample_rows).select("lang", "at", "sample").collect()
    samples: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: (r["at"], r["sample"])):
        samples[r["lang"]] = (samples.get(r["lang"], "") + "\n" + r["sample"])[:sample_chars]
    return CrossParser(samples)


def identify(docs: DataFrame, model: CrossParser, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep..., lang_pred, score 0..1) for every input row; only the text is looked at.

    ``und`` with score 0 for null texts and texts without letters. Ties, texts of letters that no sample has among
    them, go to the first language in alphabetic order. Long texts are parsed whole. Repeated rows give repeated rows, an empty table an empty result; columns
    outside ``keep`` are not read, so their names cannot clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        release()
        parser = shared.value

        def f(columns, texts):
            langs, scores = parser.predict(texts)
            return {"doc_id": columns[0], **{k: columns[2 + i] for i, k in enumerate(keep)}, "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())}

        return f

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"doc_id {kinds[id_col]}", *(f"`{k}` {kinds[k]}" for k in keep), "lang_pred string, score double"])
    carried = [F.col(f"`{k}`").alias(f"__{i}") for i, k in enumerate(keep)]
    return map_text(docs.select(id_col, text_col, *carried), make, schema, 1, PARSED_CHARS)
