"""Vector scalars over array columns, in double precision inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added to every norm.
EPSILON = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """a / (|a| + epsilon), as doubles."""
    norm = F.sqrt(dot(a, a)) + EPSILON
    return F.transform(a, lambda x: x.cast("double") / norm)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((F.sqrt(dot(a, a)) + EPSILON) * (F.sqrt(dot(b, b)) + EPSILON))
