"""Vector helpers on `array<double>` columns."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def as_doubles(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def unit(c: Column | str) -> Column:
    """Vector of unit length; a zero vector stays zero."""
    v = as_doubles(c)
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def ml_vectors(df: DataFrame, vec: str, key: str) -> DataFrame:
    """`(key, features)` with ML vectors."""
    return df.select(key, array_to_vector(as_doubles(vec)).alias("features"))
