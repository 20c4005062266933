"""Vectors as ARRAY<FLOAT>: length, product, normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    """v at length 1; a zero vector stays as it is."""
    return F.element_at(F.transform(F.array(norm(v)), lambda n: F.when(n > 0, F.transform(v, lambda x: (x / n).cast("float"))).otherwise(v)), 1)


def similarity(a: Column, b: Column) -> Column:
    """Dot product, 0 where widths differ."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), dot).otherwise(F.lit(0.0))


def distance(a: Column, b: Column) -> Column:
    return 1 - similarity(a, b)


def cohesion_description(cohesion: Column) -> Column:
    return F.when(cohesion >= 0.9, "very consistent").when(cohesion >= 0.8, "consistent").when(cohesion >= 0.7, "loose").otherwise("mixed")


def suggested_cluster_count(n: int) -> int:
    if n <= 3:
        return max(1, n)
    return min(24, max(2, int((n / 2) ** 0.5 + 0.5)))


def suggested_clusters(n: Column) -> Column:
    """suggested_cluster_count of a column."""
    return F.when(n <= 3, F.greatest(F.lit(1), n)).otherwise(F.least(F.lit(24), F.greatest(F.lit(2), F.floor(F.sqrt(n / 2) + 0.5)))).cast("int")
