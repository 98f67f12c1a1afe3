"""Splits without leakage, intervals, coverage."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_order(key: Column, seed: int = 42) -> Column:
    """A seeded order that any engine can repeat."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")).cast("binary"))


#: Leading hex digits of a hash by which keys are counted.
HASH_DIGITS = 4


def first_in_order(keys: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """The first ``n`` rows of ``keys(key)`` in hash order, without sorting them all in one place.

    Rows are counted by the first digits of their hash (16 ** ``HASH_DIGITS`` counts at most); the digits at which the
    n-th row lies split them, and only the rows that share those digits are ordered.
    """
    hashed = keys.select("key", hash_order(F.col("key"), seed).alias("h"))
    head = F.substring("h", 1, HASH_DIGITS)
    left = n
    for r in sorted(hashed.groupBy(head.alias("head")).agg(F.count("*").alias("n")).collect()):
        if r["n"] >= left:
            last = hashed.filter(head == r["head"]).orderBy("h", "key").limit(left)
            return hashed.filter(head < r["head"]).unionByName(last).select("key")
        left -= r["n"]
    return keys.select("key")


def held_out_keys(rows: DataFrame, key: Column, frac: float, seed: int = 42) -> DataFrame:
    """(key): the first max(1, floor(n * frac)) distinct keys in hash order."""
    keys = rows.select(key.cast("string").alias("key")).filter(F.col("key").isNotNull()).distinct()
    return first_in_order(keys, max(1, int(keys.count() * frac)), seed)


def split(rows: DataFrame, key: Column, frac: float = 0.2, seed: int = 42) -> DataFrame:
    """``rows`` with boolean ``held_out``: all rows of a key on the same side. A row split is a split by the row's id."""
    held = held_out_keys(rows, key, frac, seed).withColumn("__held", F.lit(True)).withColumnRenamed("key", "__key")
    return rows.join(held, key.cast("string") == F.col("__key"), "left").withColumn("held_out", F.coalesce("__held", F.lit(False))).drop("__held", "__key")


def three_way(rows: DataFrame, key: Column, valid: float = 0.15, test: float = 0.2, seed: int = 42) -> DataFrame:
    """``rows`` with ``part`` train, valid or test; all rows of a key on one side, the test keys first in hash order, then the valid ones."""
    keys = rows.select(key.cast("string").alias("key")).filter(F.col("key").isNotNull()).distinct()
    n = keys.count()
    n_test, n_valid = max(1, int(n * test)), max(1, int(n * valid))
    tested = first_in_order(keys, n_test, seed).select(F.col("key").alias("__t"))
    either = first_in_order(keys, n_test + n_valid, seed).select(F.col("key").alias("__e"))
    marked = rows.join(tested, key.cast("string") == F.col("__t"), "left").join(either, key.cast("string") == F.col("__e"), "left")
    part = F.when(F.col("__t").isNotNull(), "test").when(F.col("__e").isNotNull(), "valid").otherwise("train")
    return marked.withColumn("part", part).drop("__t", "__e")


def uniform(i: int, seed: int) -> float:
    """A seeded number in [0, 1) that any engine can repeat: the first 12 hex digits of md5("i:seed")."""
    return int(hashlib.md5(f"{i}:{seed}".encode()).hexdigest()[:12], 16) / 16**12


def binomial_draws(n: int, won: int, iterations: int, seed: int) -> np.ndarray:
    """Hits among n draws with replacement from rows of which ``won`` are hits, ``iterations`` times: by the inverse distribution.

    Only counts within 12 standard deviations of the mean are laid out, so the work grows with the root of n.
    """
    if won in (0, n):
        return np.full(iterations, won)
    p = won / n
    reach = int(12 * math.sqrt(n * p * (1 - p))) + 12
    k = np.arange(max(0, won - reach), min(n, won + reach) + 1)
    log = np.vectorize(math.lgamma)
    mass = np.exp(math.lgamma(n + 1) - log(k + 1.0) - log(n - k + 1.0) + k * math.log(p) + (n - k) * math.log1p(-p))
    at = np.searchsorted(np.cumsum(mass), [uniform(i, seed) for i in range(iterations)], side="left")
    return k[np.minimum(at, len(k) - 1)]


def bootstrap_ci(hits: DataFrame, hit: Column, iterations: int = 2000, seed: int = 42) -> DataFrame:
    """One row (lo, hi): 2.5 and 97.5 percentiles of resampled shares of hits, rounded to 3 places; zeros without rows.

    The hits of a resample of n rows are binomial, so the rows are counted once and each resample is one draw: the work
    does not grow with iterations times rows. A null ``hit`` is none.
    """
    n, won = hits.agg(F.count("*"), F.coalesce(F.sum(hit.cast("long")), F.lit(0))).first()
    lo, hi = np.percentile(binomial_draws(n, won, iterations, seed) / n, [2.5, 97.5]) if n else (0.0, 0.0)
    one = hits.sparkSession.createDataFrame([(float(lo), float(hi))], "lo double, hi double")
    return one.select(F.round("lo", 3).alias("lo"), F.round("hi", 3).alias("hi"))


def bootstrap_mean_ci(rows: DataFrame, value: Column, key: Column, iterations: int = 1000, seed: int = 42) -> DataFrame:
    """One row (mean, lo, hi) of any numeric value, by Poisson resampling in one pass.

    Every row takes part in a resample as often as a Poisson draw of mean one says, seeded by its ``key``, so results
    do not depend on how rows are dealt. A task adds up one vector of counts and one of sums over the resamples; those
    meet by addition. Null values are left out; zeros without rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(iterations), np.zeros(iterations)
        rows_seen, total = 0, 0.0
        for b in batches:
            for h, x in zip(np.asarray(b.column(0)), np.asarray(b.column(1))):
                draw = np.random.Generator(np.random.PCG64(int(h) & (1 << 63) - 1)).poisson(1.0, iterations)
                counts += draw
                sums += draw * x
                rows_seen, total = rows_seen + 1, total + float(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, iterations, dtype=np.int64)), pa.array(np.concatenate([[rows_seen], counts])), pa.array(np.concatenate([[total], sums]))], names=["i", "n", "x"])

    told = rows.select(F.xxhash64(key, F.lit(seed)).alias("h"), value.cast("double").alias("x")).filter("x IS NOT NULL")
    each = told.mapInArrow(run, "i long, n double, x double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).filter("n > 0").withColumn("m", F.col("x") / F.col("n"))
    drawn = F.when(F.col("i") >= 0, F.col("m"))
    return each.agg(*(F.coalesce(c, F.lit(0.0)).alias(name) for c, name in ((F.max(F.when(F.col("i") < 0, F.col("m"))), "mean"), (F.percentile(drawn, 0.025), "lo"), (F.percentile(drawn, 0.975), "hi"))))


def lift(rows: DataFrame, a: str, b: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean of each arm to 3 places, their difference, wins and ties of ``a``: one row, or one for each group."""
    better = F.sum((F.col(a) > F.col(b)).cast("int"))
    return rows.groupBy(*by).agg(F.round(F.avg(a), 3).alias("mean_a"), F.round(F.avg(b), 3).alias("mean_b"), F.round(F.avg(a) - F.avg(b), 3).alias("lift"), better.alias("wins"), F.sum((F.col(a) == F.col(b)).cast("int")).alias("ties"), F.count("*").alias("n"))
