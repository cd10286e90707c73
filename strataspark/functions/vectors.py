"""Vector arithmetic on array columns, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_norm(a: Column) -> Column:
    return F.aggregate(_double(a), F.lit(0.0), lambda s, x: s + x * x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine as a float; 0 for null or empty vectors, different lengths or a zero norm."""
    length = F.sqrt(squared_norm(a)) * F.sqrt(squared_norm(b))
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(usable & (length > 0), dot(a, b) / length).otherwise(0.0).cast("float")


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean distance; null for different lengths or nulls."""
    sum_ = F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.sqrt(sum_))


def unit(v: Column) -> Column:
    """The vector at length 1; null for a zero vector."""
    length = F.sqrt(squared_norm(v))
    return F.when(length > 0, F.transform(_double(v), lambda x: x / length))
