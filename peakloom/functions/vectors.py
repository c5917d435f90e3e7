"""Array expressions: padding, peak arrays, and dot products in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def padded(a: Column, length: int = 128, fill: float = 0.0) -> Column:
    """Cut or filled up to ``length``."""
    return F.slice(F.concat(a, F.array_repeat(F.lit(fill), length)), 1, length)


def pad_mask(a: Column, length: int = 128) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: i <= F.size(a))


def flattened_finite(a: Column) -> Column:
    """Entries without nulls, NaN and infinities."""
    return F.filter(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def scaled_padded(a: Column, length: int = 128, scale: float = 1000.0) -> Column:
    """Values over ``scale``, cut or filled with zeros up to ``length``."""
    return padded(F.transform(a, lambda x: x / scale), length)


def is_finite(a: Column) -> Column:
    return ~F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
