"""Dot product, norm, cosine and the hashed embedding as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = 384


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """Divided by its norm, which is computed once and not for each component; a zero vector stays zero."""
    divided = lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0))
    return F.get(F.transform(F.array(norm(a)), divided), F.lit(0))


def cosine_distance(a: Column, b: Column, length: Column | None = None) -> Column:
    """One less the cosine; a zero vector is at distance 1 from all. ``length``: b's, if it is known."""
    return F.lit(1.0) - F.coalesce(F.try_divide(dot(a, b), norm(a) * (norm(b) if length is None else length)), F.lit(0.0))


def bucket(term: Column, dimensions: int = DIMENSIONS) -> Column:
    """The dimension of a term in the hashed embedding."""
    return (F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long") % dimensions).cast("int")
