"""Vector arithmetic on ARRAY columns, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: keeps the quotient defined for a zero vector.
NORM_EPSILON = 1e-8


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    return _sum(F.zip_with(as_double(left), as_double(right), lambda x, y: x * y))


def norm(vector: Column) -> Column:
    return F.sqrt(_sum(F.transform(as_double(vector), lambda x: x * x)))


def normalize(vector: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    length = norm(vector)
    return F.when(length == 0, as_double(vector)).otherwise(
        F.transform(as_double(vector), lambda x: x / length)
    )


def cosine(left: Column, right: Column) -> Column:
    """Cosine whose norms are padded with a small constant, as in pair verification."""
    return dot(left, right) / ((norm(left) + NORM_EPSILON) * (norm(right) + NORM_EPSILON))


def euclidean(left: Column, right: Column) -> Column:
    squares = F.zip_with(as_double(left), as_double(right), lambda x, y: (x - y) * (x - y))
    return F.sqrt(_sum(squares))


def to_distance(similarity: Column) -> Column:
    return F.lit(1.0) - similarity


def to_similarity(distance: Column) -> Column:
    return F.lit(1.0) - distance
