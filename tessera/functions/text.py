"""Cleaning, gates, windows and page text as Column functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lines that are navigation or notices rather than prose (case-insensitive).
BOILERPLATE = (
    r"^\s*(accept|manage)\s+cookies",
    r"^\s*(sign in|log in|subscribe|newsletter)\b",
    r"^\s*(share|tweet|pin it|copy link)\s*$",
    r"^\s*(advertisement|sponsored)\s*$",
    r"^\s*\d+\s*(min read|comments?)\s*$",
    r"^\s*(all rights reserved|©)",
)
MIN_CHARS, MIN_WORDS = 80, 15

#: White space as Unicode has it, for texts whose rules were stated for Unicode strings.
SPACE = r"(?U)\s+"


def trimmed(c: Column) -> Column:
    """Without white space (Unicode) at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeezed(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


#: Bytes of text that are Python strings at a time (a longer text is so by itself).
COMPOSED_BYTES = 1_000_000


def _nfkc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        start = held = 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
            if held and held + n > COMPOSED_BYTES:
                yield _composed(texts.slice(start, i - start))
                start, held = i, 0
            held += n
        yield _composed(texts.slice(start))


def _composed(texts: pa.Array) -> pa.Array:
    return pa.array([t if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], texts.type)


def beyond_ascii(c: Column) -> Column:
    """The text where it has other than ASCII characters, else null: what goes to Python and what stays in the JVM."""
    return F.when(F.octet_length(c) != F.length(c), c)


def nfkc(c: Column) -> Column:
    """Compatibility composition. Spark has no such function; texts beyond ASCII go to Python in Arrow batches.

    A batch, 64 MB at most as Spark has it, stays in Arrow's form; a slice of it at a time is composed and sent back.
    """
    return F.coalesce(F.arrow_udf(_nfkc, "string")(beyond_ascii(c)), c)


def normalize_whitespace(c: Column) -> Column:
    """One line-feed style, single blanks, stripped lines, at most one empty line in a row."""
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.regexp_replace(c, "[ \t]+", " ")
    lines = F.transform(F.split(c, "\n"), lambda line: trimmed(line))
    return trimmed(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"))


def strip_boilerplate(c: Column) -> Column:
    """Drops lines that match a boilerplate pattern."""
    noise = "(?iuU)" + "|".join(f"(?:{p})" for p in BOILERPLATE)
    return F.array_join(F.filter(F.split(c, "\n"), lambda line: ~line.rlike(noise)), "\n")


def clean_text(c: Column, compose: bool = True) -> Column:
    """Compose, tidy white space, drop boilerplate, tidy again; null gives the empty text."""
    c = F.coalesce(c, F.lit(""))
    c = nfkc(c) if compose else c
    return normalize_whitespace(strip_boilerplate(normalize_whitespace(c)))


def word_count(c: Column) -> Column:
    c = squeezed(c)
    return F.when(F.coalesce(c, F.lit("")) == "", 0).otherwise(F.size(F.split(c, " ")))


def is_low_quality(c: Column, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS) -> Column:
    """Empty, shorter than ``min_chars`` characters or ``min_words`` words."""
    return F.coalesce((c == "") | (F.length(c) < min_chars) | (word_count(c) < min_words), F.lit(True))


def content_hash(c: Column) -> Column:
    """SHA-1 of the text in lower case with single blanks: equal for texts that differ in case or spacing only."""
    return F.sha1(squeezed(F.lower(c)).cast("binary"))


def char_windows(c: Column, size: int = 2500, overlap: int = 200, most: int | None = None) -> Column:
    """array<struct<i, window>>: windows of ``size`` characters, starts ``size - overlap`` apart; the first ``most`` if given.

    Every character is in a window unless ``most`` cuts; null and empty texts have none.
    """
    step = size - overlap
    n = F.ceil(F.length(c) / step).cast("int")
    n = n if most is None else F.when(n > most, F.lit(most)).otherwise(n)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("i"), F.substring(c, i * step + 1, F.lit(size)).alias("window")))


def word_windows(c: Column, size: int = 350, overlap: int = 40, least: int = 30) -> Column:
    """array<struct<i, window>>: overlapping windows of words; those under ``least`` words are dropped.

    A text of at most ``size`` words is one window. The last window is the first that reaches the end.
    """
    words = F.filter(F.split(squeezed(c), " "), lambda w: w != "")
    step = max(1, size - overlap)
    n = F.size(words)
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step).cast("int"))
    found = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("i"), F.slice(words, i * step + 1, F.lit(size)).alias("w")))
    kept = F.filter(found, lambda s: F.size(s["w"]) >= least)
    return F.transform(kept, lambda s: F.struct(s["i"].alias("i"), F.array_join(s["w"], " ").alias("window")))


def clean_page(c: Column) -> Column:
    """Book pages: joins hyphenated line ends, drops blank, tiny and page-number lines, one line of single blanks."""
    lines = F.transform(F.split(F.replace(c, F.lit("-\n"), F.lit("")), "\n"), lambda line: trimmed(line))
    kept = F.filter(lines, lambda line: (F.length(line) > 2) & ~line.rlike(r"^\d{1,4}$"))
    return squeezed(F.array_join(kept, " "))


def title_from_stem(c: Column) -> Column:
    return F.translate(c, "-_", "  ")


def is_scanned(first_pages: Column, pages: int = 5, least: int = 100) -> Column:
    """Whether a document's first pages hold too little text to be anything but images."""
    return F.length(trimmed(F.array_join(F.slice(first_pages, 1, pages), ""))) < least
