"""Cluster labels and planar coordinates of vectors, and an evaluation-only contrastive loss."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kmeans_labels(df: DataFrame, *, k: int = 10, seeds: tuple[int, ...] = (42,), ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(ident, cluster) of the KMeans model of least cost over the seeds."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.filter(F.col(vector).isNotNull()).select(ident, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    models = [KMeans(k=k, seed=s, maxIter=20).fit(rows) for s in seeds]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(rows).select(ident, F.col("prediction").alias("cluster"))


def plane(df: DataFrame, *, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(ident, x, y): the first two principal components. They stand in for a manifold embedding, which needs libraries Spark lacks."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.filter(F.col(vector).isNotNull()).select(ident, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    xy = PCA(k=2, inputCol="features", outputCol="p").fit(rows).transform(rows).select(ident, vector_to_array("p").alias("p"))
    return xy.select(ident, F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def contrastive_loss(pairs: DataFrame, *, temperature: float = 0.07) -> DataFrame:
    """Mean NT-Xent loss of a similarity table (anchor, candidate, similarity, positive): evaluation only."""
    e = F.exp(F.col("similarity") / temperature)
    per = pairs.groupBy("anchor").agg(F.sum(F.when(F.col("positive"), e)).alias("p"), F.sum(e).alias("a"))
    return per.filter("p > 0").agg(F.avg(-F.log(F.col("p") / F.col("a"))).alias("loss"), F.count(F.lit(1)).alias("n_anchors"))
