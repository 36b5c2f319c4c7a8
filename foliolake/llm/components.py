"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolake.runtime import drop_materialized, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", *, max_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of an edge: the root is the smallest node of its component.

    Each round points nodes at the smallest node they see (large star: the greater neighbours, small star: the lesser ones), so
    paths shrink as in pointer jumping and a number of rounds that grows with the logarithm of the size suffices. A round is two
    aggregates and joins over an edge table that never grows; each round's table is written to the shared folder, so a lost
    executor costs one round at most. Self-loops give a node of its own; nulls are ignored; no edges give no rows.
    """
    clean = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (F.col(a).isNotNull() & F.col(b).isNotNull()).alias("ok"))
    given = materialize(clean.filter("ok").select("u", "v").distinct(), "edges")
    nodes, cur = given.filter("u = v").select(F.col("u").alias("node")), given.filter("u != v")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())

    seen = mark(cur)
    for rounds in range(max_rounds):
        if not seen[0]:
            break
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # A node that is its neighbourhood's smallest keeps its edges to the greater ones through the pairs above.
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        nxt = (
            small.filter("v != m")
            .select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .filter("u != v")
            .distinct()
        )
        nxt = materialize(nxt, "edges")
        now = mark(nxt)
        if rounds:
            drop_materialized(cur)
        cur = nxt
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    tops = roots.select(F.col("root").alias("node")).unionByName(nodes).distinct().join(roots.select("node"), "node", "left_anti")
    return roots.unionByName(tops.select("node", F.col("node").alias("root")))
