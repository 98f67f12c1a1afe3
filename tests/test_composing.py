"""Composition holds a slice of a batch as Python strings, not the batch."""

import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions import text as X


def test_a_batch_is_composed_in_slices():
    texts = [None if i % 7 == 0 else "ﬁé" * 20_000 for i in range(60)] + ["é" * 2_000_000, "", "ﬁ"]
    got = list(X._nfkc(iter([pa.array(texts), pa.array([], pa.string())])))
    assert all(len(part) == 1 or part.nbytes < 1.1 * X.COMPOSED_BYTES for part in got) and len(got) > 6
    assert pa.concat_arrays(got).to_pylist() == [t and unicodedata.normalize("NFKC", t) for t in texts]


def test_rows_keep_their_texts(spark):
    texts = [None, "", "plain", "ﬁne", "e\u0301" * 300_000, "Å" * 600_000] * 5
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1).select("i", X.nfkc(F.col("t")).alias("t"))
    assert [r["t"] for r in rows.orderBy("i").collect()] == [t and unicodedata.normalize("NFKC", t) for t in texts]
