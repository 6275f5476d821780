"""Column functions over dense vectors, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if a vector is empty or null, lengths differ, or a norm is not positive."""
    aa, bb = dot(a, a), dot(b, b)
    good = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (aa > 0) & (bb > 0)
    return F.coalesce(F.when(good, dot(a, b) / F.sqrt(aa * bb)), F.lit(0.0))


def vector_literal(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def normalize(a: Column) -> Column:
    """A vector of length 1; a zero vector is unchanged."""
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(a, lambda x: x.cast("double") / norm)).otherwise(F.transform(a, lambda x: x.cast("double")))


def centroids(vectors: DataFrame, key: str, vector: str, digits: int = 9) -> DataFrame:
    """The mean vector of each key, averaged per dimension by partial aggregates (dimensions from 0)."""
    long = vectors.select(key, F.posexplode(vector).alias("dim", "x"))
    means = long.groupBy(key, "dim").agg(F.round(F.avg(F.col("x").cast("double")), digits).alias("m"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("centroid"))
