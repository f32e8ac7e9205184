"""Vectors as ARRAY<DOUBLE> columns: products, norms, distances, means."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import ColumnLike, col


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


def dot(a: ColumnLike, b: ColumnLike) -> Column:
    """Inner product over the shorter length."""
    return _sum(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: ColumnLike) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: ColumnLike) -> Column:
    """The vector over its norm; null for the zero vector."""
    return F.when(norm(v) != 0, F.transform(col(v), lambda x: x.cast("double") / norm(v)))


def cosine(a: ColumnLike, b: ColumnLike) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def angle_distance(a: ColumnLike, b: ColumnLike) -> Column:
    return F.abs(cosine(a, b) - 1)


def euclid(a: ColumnLike, b: ColumnLike) -> Column:
    return F.sqrt(_sum(F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def midpoint(a: ColumnLike, b: ColumnLike) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") + y.cast("double")) / 2)


def mean_vector(v: str) -> Column:
    """Aggregate: the element-wise mean of a group's vectors of equal size, from sums and counts only (no list of the group is built)."""
    from pyspark.ml.stat import Summarizer
    from pyspark.ml.functions import array_to_vector, vector_to_array

    return vector_to_array(Summarizer.mean(array_to_vector(F.col(v).cast("array<double>"))))


def cumsum(values: ColumnLike) -> Column:
    """Running sums of an array."""
    start = F.struct(F.lit(0.0).alias("total"), F.array().cast("array<double>").alias("out"))
    step = lambda a, x: F.struct((a["total"] + x).alias("total"), F.array_append(a["out"], a["total"] + x).alias("out"))
    return F.aggregate(col(values), start, step, lambda a: a["out"])


def total(values: ColumnLike) -> Column:
    return _sum(F.transform(col(values), lambda x: x.cast("double")))


def product(values: ColumnLike) -> Column:
    return F.aggregate(col(values), F.lit(1.0), lambda a, x: a * x)


def lockstep_sum(a: ColumnLike, b: ColumnLike) -> Column:
    """Sum of products of elements in step: the map-reduce of two collections side by side."""
    return dot(a, b)


def cross_sum(a: ColumnLike, b: ColumnLike) -> Column:
    """Sum of products over the cross product of two arrays, which factorises."""
    return total(a) * total(b)


def lockstep_product(a: ColumnLike, b: ColumnLike) -> Column:
    """Product over element sums in step."""
    return product(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") + y.cast("double")))
