"""Vectors as arrays of floats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column, kind: str = "float") -> Column:
    """Left-to-right sum of products over the shorter length; NaN counts as -1."""
    n = F.least(F.size(a), F.size(b))
    parts = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: (x.cast(kind) * y.cast(kind)).cast(kind))
    return F.nanvl(F.aggregate(parts, F.lit(0).cast(kind), lambda s, x: (s + x).cast(kind)), F.lit(-1).cast(kind))


def normalized(v: Column, kind: str = "float") -> Column:
    """v at length 1; as it is if its length is 1e-9 or less."""
    norm = F.sqrt(F.aggregate(v, F.lit(0).cast(kind), lambda s, x: (s + x * x).cast(kind))).cast(kind)
    return F.when(norm > 1e-9, F.transform(v, lambda x: (x / norm).cast(kind))).otherwise(v)


def mean_vectors(rows: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """by and centroid: the normalised sum of each group's vectors, summed by position in partial aggregates."""
    parts = rows.select(*by, F.posexplode(vector).alias("pos", "x")).groupBy(*by, "pos").agg(F.sum(F.col("x").cast("double")).alias("s"))
    sums = parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda p: p["s"]).alias("v"))
    return sums.select(*by, normalized(F.col("v"), "double").alias("centroid"))
