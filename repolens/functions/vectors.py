"""Set and vector similarity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """0 when a side is missing, sizes differ or a norm is zero."""
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b))
    norms = norm(a) * norm(b)
    return F.when(usable & (norms > 0), dot(a, b) / norms).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Both empty -> 1. Inputs are sets (no repeats)."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def set_distance(a: Column, b: Column) -> Column:
    """1 - Jaccard, and 1 when either side is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(1.0)).otherwise(1.0 - jaccard(a, b))


def shared_prefix_length(a: Column, b: Column) -> Column:
    """Length of the leading run of equal parts."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull()),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("open")),
        lambda acc, same: F.struct(
            F.when(acc["open"] & same, acc["n"] + 1).otherwise(acc["n"]).alias("n"),
            (acc["open"] & same).alias("open"),
        ),
        lambda acc: acc["n"],
    )
