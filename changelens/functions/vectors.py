"""Vector expressions: unit vectors, exact cosine, and the guard of a vector space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def is_usable(vector: Column) -> Column:
    """Finite and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & (norm(vector) > 0), F.lit(False))


def unit(vector: Column) -> Column:
    """Divided by its length; NULL for vectors that are not usable."""
    length = norm(vector)
    return F.when(is_usable(vector), F.transform(vector, lambda x: x / length))


def cosine(a: Column, b: Column) -> Column:
    """Inner product of unit vectors within [-1, 1]; NULL if their dimensions differ, never padded."""
    return F.when(F.size(a) == F.size(b), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b))))


def space_violation(vector: Column, space: Column, expected_space: str, dimension: int) -> Column:
    return F.when(space != expected_space, "space_mismatch").when(F.size(vector) != dimension, "dimension_mismatch").when(~is_usable(vector), "invalid_vector")
