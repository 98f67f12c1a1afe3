import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X


@pytest.mark.parametrize("most", (None, 4))
def test_char_windows_reach_the_end_unless_capped(spark, most):
    text = "".join(chr(97 + i % 26) for i in range(128_657))
    rows = spark.createDataFrame([(0, text), (1, ""), (2, None), (3, "x" * 2300), (4, "x" * 2301)], "i int, t string")
    got = {r["i"]: [(w["i"], w["window"]) for w in r["v"]] for r in rows.select("i", X.char_windows(F.col("t"), most=most).alias("v")).collect()}
    want = [(i, text[a : a + 2500]) for i, a in enumerate(range(0, len(text), 2300))]
    assert got[0] == want[:most] and got[1] == got[2] == [] and [len(got[3]), len(got[4])] == [1, 2]
