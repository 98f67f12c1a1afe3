"""Vector expressions over ARRAY columns, folded left in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_NORM = 1e-8


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column) -> Column:
    """Scaled to length one; a norm under 1e-8 counts as that."""
    n = F.greatest(norm(v), F.lit(LEAST_NORM))
    return F.transform(doubles(v), lambda x: x / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(LEAST_NORM)) * F.greatest(norm(b), F.lit(LEAST_NORM)))


def matrix(rows: list[list[float]]) -> Column:
    """A literal matrix as array<array<double>>."""
    return F.array(*(F.array(*(F.lit(float(x)) for x in r)) for r in rows))


def project(v: Column, weights: Column) -> Column:
    """weights (rows of coefficients) times v, scaled to length one."""
    return normalized(F.transform(weights, lambda w: dot(w, v)))


def relu_mlp(v: Column, w1: Column, b1: Column, w2: Column, b2: float) -> Column:
    """Logistic score of a one-hidden-layer head; ``w1`` holds one row of input weights for each hidden unit."""
    hidden = F.zip_with(w1, b1, lambda w, b: F.greatest(dot(w, v) + b, F.lit(0.0)))
    return 1 / (1 + F.exp(-(dot(hidden, w2) + F.lit(float(b2)))))


def score_100(score: Column) -> Column:
    """Half-even rounding of a hundred times the score."""
    return F.bround(100 * score, 0).cast("int")
