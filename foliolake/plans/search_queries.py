"""Similarity search and vector statistics, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolake.functions.vectors import mean_vector, mean_vector_long
from foliolake.operators import learn, search
from foliolake.runtime import table


def _e(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def _r(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


def knn_cosine(spark, d):
    e = _e(spark, d)
    return _r(search.top_k(e, e.filter("vec_id = 0"), 10), "similarity")


def knn_eps(spark, d):
    e = _e(spark, d)
    return _r(search.top_k(e, e.filter("vec_id = 7"), 25, eps=1e-8), "similarity")


def knn_filtered(spark, d):
    e = _e(spark, d)
    q = e.filter("vec_id = 0")
    same = e.join(F.broadcast(q.select("label")), "label", "left_semi")  # one row
    return _r(search.top_k(same, q, 10), "similarity")


def knn_batch(spark, d):
    e = _e(spark, d)
    return _r(search.top_k_batch(e, e.filter("vec_id % 100 = 0"), 3), "similarity")


def knn_recursive(spark, d):
    e = _e(spark, d)
    return _r(search.recursive_search(e, e.filter("vec_id = 3"), k=3, depth=3), "similarity")


def knn_pinned(spark, d):
    e = _e(spark, d)
    return _r(search.pinned(e, e.filter("vec_id = 11"), 10), "similarity")


def hybrid_fusion(spark, d):
    e = _e(spark, d)
    return _r(search.hybrid(e, [(e.filter("vec_id = 1"), 0.5), (e.filter("vec_id = 2"), 0.5)], 10), "score")


def mean_pool(spark, d):
    return _r(mean_vector_long(_e(spark, d), "label", "embedding"), "mean")


def mean_pool_arrays(spark, d):
    return mean_vector(_e(spark, d), "label", "embedding", 64).withColumn("mean", F.transform("mean", lambda x: F.round(x, 6)))


def panel_flatten(spark, d):
    """Vectors cut into eight panels of eight numbers each, one row for each panel."""
    e = _e(spark, d)
    p = e.select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("panel_id"), "embedding")
    part = F.slice("embedding", F.col("panel_id") * 8 + 1, 8)
    return _r(p.select("vec_id", "panel_id", F.aggregate(part, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")).alias("energy")), "energy")


def intra_inter_similarity(spark, d):
    return _r(search.intra_inter(_e(spark, d)), "intra", "inter")


def vector_stats(spark, d):
    x = F.col("x").cast("double")
    long = table(spark, d, "page_vectors").select(F.explode("page_embeddings").alias("x"))
    ok = ~F.isnan("x")
    return _r(
        long.agg(
            F.count("x").alias("n"), F.sum(F.isnan("x").cast("int")).alias("n_nan"), F.sum((F.abs("x") == float("inf")).cast("int")).alias("n_inf"), F.sum((F.col("x") == 0).cast("int")).alias("n_zero"),
            F.avg(F.when(ok, x)).alias("mean"), F.stddev_pop(F.when(ok, x)).alias("std"), F.min(F.when(ok, x)).alias("min"), F.max(F.when(ok, x)).alias("max"),
        ),
        "mean", "std", "min", "max",
    )


def zero_norm_filter(spark, d):
    """How many vectors survive a norm above 1e-6, by source."""
    v = table(spark, d, "page_vectors")
    n2 = F.aggregate("page_embeddings", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return v.groupBy("source").agg(F.count(F.when(F.sqrt(n2) > 1e-6, 1)).alias("kept"), F.count(F.lit(1)).alias("n"))


def kmeans_clusters(spark, d):
    return learn.kmeans_labels(_e(spark, d))


def planar_coordinates(spark, d):
    return learn.plane(_e(spark, d))


def contrastive_eval(spark, d):
    """Loss of the stated queries against all rows."""
    e = _e(spark, d)
    q = e.filter("vec_id % 100 = 0")
    names = q.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql"))
    sims = search.all_similarities(e, q).filter("query_id != vec_id")
    pairs = sims.join(names, "query_id").join(e.select("vec_id", "label"), "vec_id").select(F.col("query_id").alias("anchor"), F.col("vec_id").alias("candidate"), "similarity", (F.col("ql") == F.col("label")).alias("positive"))
    return _r(learn.contrastive_loss(pairs), "loss")


_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_RANK = "row_number() OVER (ORDER BY similarity DESC, vec_id)"


def _knn(where: str, qid: int, k: int, more: str = "") -> str:
    return f"""WITH s AS (SELECT e.vec_id, {_COS} AS similarity FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = {qid}) q {where})
        SELECT vec_id, round(similarity, 6) AS similarity, {_RANK} AS rank {more} FROM s ORDER BY similarity DESC, vec_id LIMIT {k}"""


SQL = {
    "knn_cosine": _knn("", 0, 10),
    "knn_eps": _knn("", 7, 25),
    "knn_filtered": _knn("WHERE e.label = q.label", 0, 10),
    "knn_batch": f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, {_COS} AS similarity FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s)
        SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= 3""",
    "knn_recursive": f"""WITH s1 AS (SELECT q.vec_id AS query_id, e.vec_id, {_COS} AS similarity FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 3) q),
        r1 AS (SELECT 1 AS step, * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s1) WHERE rank <= 3),
        q2 AS (SELECT * FROM embeddings WHERE vec_id IN (SELECT vec_id FROM r1) AND vec_id <> 3),
        s2 AS (SELECT q.vec_id AS query_id, e.vec_id, {_COS} AS similarity FROM embeddings e, q2 q),
        r2 AS (SELECT 2 AS step, * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s2) WHERE rank <= 3),
        q3 AS (SELECT * FROM embeddings WHERE vec_id IN (SELECT vec_id FROM r2) AND vec_id NOT IN (SELECT vec_id FROM q2) AND vec_id <> 3),
        s3 AS (SELECT q.vec_id AS query_id, e.vec_id, {_COS} AS similarity FROM embeddings e, q3 q),
        r3 AS (SELECT 3 AS step, * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s3) WHERE rank <= 3)
        SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank, step FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3)""",
    "knn_pinned": f"""WITH s AS (SELECT e.vec_id, {_COS} AS similarity, e.vec_id = q.vec_id AS is_query FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 11) q)
        SELECT vec_id, round(similarity, 6) AS similarity, is_query, row_number() OVER (ORDER BY is_query DESC, similarity DESC, vec_id) AS rank FROM s
        ORDER BY is_query DESC, s.similarity DESC, vec_id LIMIT 10""",
    "hybrid_fusion": f"""WITH a AS (SELECT e.vec_id, {_COS} AS s FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 1) q ORDER BY s DESC, e.vec_id LIMIT 100),
        b AS (SELECT e.vec_id, {_COS} AS s FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 2) q ORDER BY s DESC, e.vec_id LIMIT 100),
        f AS (SELECT vec_id, 0.5 * coalesce(a.s, 0) + 0.5 * coalesce(b.s, 0) AS score FROM a FULL JOIN b USING (vec_id))
        SELECT vec_id, round(score, 6) AS score FROM f ORDER BY round(f.score, 9) DESC, vec_id LIMIT 10""",
    "mean_pool": """SELECT label, i - 1 AS dim, round(avg(embedding[i]::DOUBLE), 6) AS mean FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY label, i""",
    "mean_pool_arrays": """SELECT label, any_value(n) AS n, list(mean ORDER BY i) AS mean FROM (SELECT label, i, count(*) AS n, round(avg(embedding[i]::DOUBLE), 6) AS mean
        FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings WHERE len(embedding) = 64) GROUP BY label, i) GROUP BY label""",
    "panel_flatten": """SELECT vec_id, panel_id, round(list_sum(list_transform(embedding[panel_id * 8 + 1 : panel_id * 8 + 8], lambda x: x::DOUBLE * x::DOUBLE)), 6) AS energy
        FROM (SELECT vec_id, embedding, unnest(range(0, 8)) AS panel_id FROM embeddings)""",
    "intra_inter_similarity": f"""SELECT round(avg(CASE WHEN e.label = q.label THEN {_COS} END), 6) AS intra, round(avg(CASE WHEN e.label <> q.label THEN {_COS} END), 6) AS inter
        FROM embeddings e, embeddings q WHERE e.vec_id < q.vec_id""",
    "contrastive_eval": f"""WITH s AS (SELECT q.vec_id AS anchor, exp({_COS} / 0.07) AS x, q.label = e.label AS positive FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q WHERE e.vec_id <> q.vec_id),
        a AS (SELECT anchor, sum(x) FILTER (positive) AS p, sum(x) AS a FROM s GROUP BY anchor) SELECT round(avg(-ln(p / a)), 6) AS loss, count(*) AS n_anchors FROM a WHERE p > 0""",
    "vector_stats": """WITH l AS (SELECT unnest(page_embeddings)::DOUBLE AS x FROM page_vectors)
        SELECT count(x) AS n, sum(isnan(x)::INT) AS n_nan, sum(isinf(x)::INT) AS n_inf, sum((x = 0)::INT) AS n_zero, round(avg(x) FILTER (NOT isnan(x)), 6) AS mean, round(stddev_pop(x) FILTER (NOT isnan(x)), 6) AS std,
        round(min(x) FILTER (NOT isnan(x)), 6) AS min, round(max(x) FILTER (NOT isnan(x)), 6) AS max FROM l""",
    "zero_norm_filter": """SELECT source, count(CASE WHEN s > 1e-6 THEN 1 END) AS kept, count(*) AS n FROM (SELECT source,
        sqrt(list_sum(list_transform(page_embeddings, lambda x: x::DOUBLE * x::DOUBLE))) AS s FROM page_vectors) GROUP BY source""",
}

QUERIES = {
    f.__name__: f
    for f in (
        knn_cosine, knn_eps, knn_filtered, knn_batch, knn_recursive, knn_pinned, hybrid_fusion, mean_pool, mean_pool_arrays, panel_flatten,
        intra_inter_similarity, vector_stats, zero_norm_filter, kmeans_clusters, planar_coordinates, contrastive_eval,
    )
}
