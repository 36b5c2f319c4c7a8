"""Exact cosine search: single, filtered, batched, recursive, pinned and hybrid.

A query vector is one row; it is joined to all rows and only the best k of each partition travel (TakeOrderedAndProject, or a
window cut to k rows for each query before the shuffle). Queries in bulk stay a stated query set held against all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolake.functions.vectors import cosine
from foliolake.runtime import materialize


def top_k(base: DataFrame, query: DataFrame, k: int, *, ident: str = "vec_id", vector: str = "embedding", eps: float = 0.0, where: Column | None = None) -> DataFrame:
    """(ident, similarity, rank) of the k rows of ``base`` most like the first row of ``query``; the query's own row isn't excluded.

    k above the number of rows gives all rows; ties go by ident; rows without a comparable vector are left out. No query row: no rows.
    """
    q = query.select(F.col(vector).alias("_q")).limit(1)
    rows = base if where is None else base.filter(where)
    sims = rows.crossJoin(F.broadcast(q)).select(ident, cosine(vector, "_q", eps).alias("similarity")).filter("similarity is not null")  # one row
    best = sims.orderBy(F.desc("similarity"), ident).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), ident)))


def all_similarities(base: DataFrame, queries: DataFrame, *, ident: str = "vec_id", vector: str = "embedding", eps: float = 0.0) -> DataFrame:
    """(query_id, ident, similarity): each row of ``queries``, a stated query set, against all rows of ``base``. Pairs without a cosine are
    left out. For an aggregate by query, which sends one state for each query and partition."""
    q = queries.select(F.col(ident).alias("query_id"), F.col(vector).alias("_q"))
    return base.select(ident, vector).join(q, F.lit(True)).select("query_id", ident, cosine(vector, "_q", eps).alias("similarity")).filter("similarity is not null")


def top_k_batch(base: DataFrame, queries: DataFrame, k: int, *, ident: str = "vec_id", vector: str = "embedding", eps: float = 0.0) -> DataFrame:
    """(query_id, ident, similarity, rank) for each row of ``queries``: each query against all rows of ``base``.

    The query set is broadcast only while Spark's own size estimate allows it; the join is nested-loop over query blocks either way.
    """
    sims = all_similarities(base, queries, ident=ident, vector=vector, eps=eps)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), ident)
    return sims.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def recursive_search(base: DataFrame, start: DataFrame, *, k: int, depth: int, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Results become the queries of the next step: (step, query_id, ident, similarity, rank). A row is a query once at most, in the
    first step that finds it; at most k ** depth queries, whatever the table's size."""
    queries, seen, out = start, start.select(ident).distinct(), None
    for step in range(1, depth + 1):
        # Written down, for what follows reads it several times: no step repeats the search of another.
        found = materialize(top_k_batch(base, queries, k, ident=ident, vector=vector).withColumn("step", F.lit(step)), "step")
        out = found if out is None else out.unionByName(found)
        new = found.select(ident).distinct().join(seen, ident, "left_anti")
        seen = seen.unionByName(new)
        queries = base.join(new, ident, "left_semi")
    return out


def pinned(base: DataFrame, query: DataFrame, k: int, *, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """As :func:`top_k` with the query's own row in rank 1, k rows in all."""
    q = query.select(F.col(ident).alias("_qid"), F.col(vector).alias("_q")).limit(1)
    sims = base.crossJoin(F.broadcast(q)).select(ident, cosine(vector, "_q").alias("similarity"), (F.col(ident) == F.col("_qid")).alias("is_query"))  # one row
    order = [F.desc("is_query"), F.desc("similarity"), F.col(ident)]
    best = sims.filter("similarity is not null or is_query").orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def hybrid(base: DataFrame, queries: list[tuple[DataFrame, float]], k: int, *, search_k: int = 100, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Weighted sum of several searches' similarities: each gives its best ``search_k``, a row missing from one counts 0 there."""
    parts = [top_k(base, q, search_k, ident=ident, vector=vector).select(ident, (F.col("similarity") * w).alias("s")) for q, w in queries]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(ident).agg(F.sum("s").alias("score")).orderBy(F.desc(F.round("score", 9)), ident).limit(k)


def stable_sample(df: DataFrame, n: int, *, ident: str, seed: int = 42) -> DataFrame:
    """n rows by hash of the key: the same rows for the same seed, however the table is partitioned."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(ident).cast("string"))), ident).limit(n)


def intra_inter(df: DataFrame, *, ident: str = "vec_id", group: str = "label", vector: str = "embedding") -> DataFrame:
    """Mean cosine of different rows within a group and across groups.

    No pair is formed: with unit vectors u, the sum over all ordered pairs is |sum u| squared, and the pairs of a row with itself
    count 1 each. One aggregate per group, one over the groups.
    """
    unit = df.withColumn("_n", F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).filter("_n > 0")
    long = unit.select(group, F.posexplode(vector).alias("d", "x"), "_n").withColumn("u", F.col("x").cast("double") / F.col("_n"))
    per = long.groupBy(group, "d").agg(F.sum("u").alias("s"))
    sizes = unit.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    within = per.groupBy(group).agg(F.sum(F.col("s") * F.col("s")).alias("ss")).join(sizes, group)
    w = within.agg(F.sum(F.col("ss") - F.col("n")).alias("w_sum"), F.sum(F.col("n") * (F.col("n") - 1)).alias("w_n"), F.sum("n").alias("n"))
    a = per.groupBy("d").agg(F.sum("s").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("all_ss"))
    both = w.crossJoin(a)  # one row each
    inter_n = F.col("n") * (F.col("n") - 1) - F.col("w_n")
    return both.select(
        (F.col("w_sum") / F.nullif("w_n", F.lit(0))).alias("intra"), ((F.col("all_ss") - F.col("n") - F.col("w_sum")) / F.nullif(inter_n, F.lit(0))).alias("inter")
    )
