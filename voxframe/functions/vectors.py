"""Column functions for vectors in arrays. Higher-order functions; block joins of many vectors are in operators.similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, unlike sizes and a squared norm of 1e-12 or less."""
    na, nb = dot(a, a), dot(b, b)
    fits = (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(fits & (na > 1e-12) & (nb > 1e-12), dot(a, b) / (F.sqrt(na) * F.sqrt(nb))).otherwise(0.0)


def l2_normalise(v: Column) -> Column:
    n = F.sqrt(dot(v, v))
    return F.when(n > 1e-12, F.transform(v, lambda x: x.cast("double") / n)).otherwise(v)


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def canonical_pair(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)
