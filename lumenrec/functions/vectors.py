"""Vector arithmetic on array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def normalise(a, epsilon: float = 0.0) -> Column:
    """The vector divided by its length (+ epsilon); the length is computed once a row."""
    return F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: x / (n + epsilon)))[0]


def mean_vector(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Elementwise mean by key, as ``key, vector``; sums are combined before the shuffle."""
    long = rows.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"))
    return long.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(vector))
