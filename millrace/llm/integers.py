"""Integer vectors: which rows take part, and components as whole numbers that 64-bit sums can hold."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    each = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, each), F.lit(False))


def limit(dimension: int) -> int:
    """The largest component for which squared distances and inner products of whole vectors fit 62 bits."""
    return isqrt((1 << 62) // (4 * max(1, dimension)))


def floored(rows: DataFrame, scale: int, vector: str = "v") -> tuple[DataFrame, int]:
    """Rows with finite vectors of the commonest length (ties: the shorter), as floor(scale * x); and that length.

    Components beyond :func:`limit` are set to it; at 64 components that is 2 ** 27, far from any unit vector's.
    """
    good = rows.withColumn(vector, F.col(vector).cast("array<double>")).where(finite(F.col(vector)))
    sizes = good.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return good.withColumn(vector, F.col(vector).cast("array<long>")), 0
    d = sizes[0]["d"]
    most = F.lit(limit(d))
    whole = lambda x: F.greatest(-most, F.least(most, F.floor(F.lit(float(scale)) * x)))
    return good.where(F.size(vector) == d).withColumn(vector, F.transform(vector, whole)), d
