"""Vector arithmetic on array columns, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products in double precision; null where either is null or lengths differ."""
    a, b = _col(a), _col(b)
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), total)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str, eps: float = 0.0) -> Column:
    """Cosine; with ``eps`` both lengths are increased by it (``v / (|v| + eps)``). Null for a zero vector where eps is 0."""
    return dot(a, b) / F.nullif((norm(a) + eps) * (norm(b) + eps), F.lit(0.0))


def mean_vector_long(df, key: str, vector: str, *, index: str = "dim"):
    """(key, dim, mean): element-wise mean in long form; dims from 0. Elements that are null or NaN don't count."""
    long = df.select(key, F.posexplode(vector).alias(index, "x")).filter("x is not null and not isnan(x)")
    return long.groupBy(key, index).agg(F.avg(F.col("x").cast("double")).alias("mean"))


def mean_vector(df, key: str, vector: str, dim: int):
    """(key, n, mean array): one algebraic sum for each element, combined map-side."""
    v = F.col(vector)
    sums = df.filter(F.size(v) == dim).groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.sum(v[i].cast("double")).alias(f"s{i}") for i in range(dim)])
    return sums.select(key, "n", F.array(*[F.col(f"s{i}") / F.col("n") for i in range(dim)]).alias("mean"))
