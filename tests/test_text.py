import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import ingest


def value(spark, column, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", column(F.col("t")).alias("v")).orderBy("i")
    return [r["v"] for r in rows.collect()]


def test_clean(spark):
    page = "Great trench coats.\nAccept cookies\nSubscribe\n  12 min read \nShare\n© 2020\nWool is  warm."
    assert value(spark, X.clean_text, "a   b\t\tc", "a\n\n\n\n\nb", page, "", None, "ﬁne\r\nx\ry") == ["a b c", "a\n\nb", "Great trench coats.\nWool is warm.", "", "", "fine\nx\ny"]


def test_hash_and_gate(spark):
    a, b, c = value(spark, X.content_hash, "Wide-leg  JEANS", "wide-leg jeans", "peplum top")
    assert a == b != c
    assert value(spark, X.is_low_quality, "too short", "word " * 40, "", None, "a" * 200) == [True, False, True, True, True]
    assert value(spark, X.word_count, " a  b\nc ", "", "x y") == [3, 0, 2]


def test_documents_end_to_end(spark):
    body = "detail " * 30
    rows = [(0, f"Accept cookies\nIntro\n{body}", "a"), (1, "junk", "a"), (2, f"Intro {body}", "a"), (3, f"intro {body}", "b")]
    out = ingest.clean_documents(spark.createDataFrame(rows, "ord long, text string, source string")).orderBy("ord").collect()
    assert [(r["ord"], r["source"]) for r in out] == [(0, "a"), (3, "b")]


def test_windows(spark):
    words = lambda n: " ".join(map(str, range(n)))
    chars, = value(spark, X.char_windows, "x" * 5000)
    assert [(w["i"], len(w["window"])) for w in chars] == [(0, 2500), (1, 2500), (2, 400)]
    got = value(spark, X.word_windows, words(20), words(30), words(350), words(351), words(660), words(661), "")
    assert [[(w["i"], len(w["window"].split())) for w in g] for g in got] == [[], [(0, 30)], [(0, 350)], [(0, 350), (1, 41)], [(0, 350), (1, 350)], [(0, 350), (1, 350), (2, 41)], []]


def test_pages(spark):
    assert value(spark, X.clean_page, "a word bro-\nken here\n12\nab\n\nnext line", "") == ["a word broken here next line", ""]
    assert value(spark, X.title_from_stem, "coco-chanel_x") == ["coco chanel x"]


def test_recursive_splitter():
    text = "\n\n".join("sentence number %d is here. and more of it" % i for i in range(60))
    chunks = list(ingest.split_recursive(text))
    assert all(len(c) <= 512 for c in chunks) and len(chunks) > 4
    assert all(any(c in d for d in (text,)) for c in chunks)
    assert chunks[0][-40:] in chunks[1] or chunks[1][:20] in chunks[0]
    assert list(ingest.split_recursive("w" * 900)) == ["w" * 900]
    assert list(ingest.split_recursive("")) == []


def test_upsert_keeps_the_last(spark):
    start = "s" * 64
    rows = [(0, "a", 0, start + "old"), (1, "a", 0, start + "new"), (2, "b", 0, start + "old")]
    out = ingest.upsert(spark.createDataFrame(rows, "ord long, source string, i int, chunk string"), "ord").collect()
    assert sorted((r["source"], r["chunk"][-3:]) for r in out) == [("a", "new"), ("b", "old")]


def test_stats_and_limits(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(6)], "ord long, source string")
    got = {tuple(r) for r in ingest.run_stats(rows, rows.filter("source = 'a'"), rows.limit(0)).collect()}
    assert got == {("a", 3, 3, 0), ("b", 3, 0, 0)}
    assert [r["ord"] for r in ingest.first_n(rows, 2).collect()] == [0, 1]


@pytest.mark.parametrize(("pages", "scanned"), [(["", " x "], True), (["y" * 60, "z" * 60], False)])
def test_scanned(spark, pages, scanned):
    row = spark.createDataFrame([(pages,)], "p array<string>").select(X.is_scanned(F.col("p")).alias("s")).first()
    assert row["s"] is scanned
