"""Taking a budget's worth of rows by hash, without sorting: nested thresholds from histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096


def _level(h: Column, level: int) -> Column:
    return F.pmod(F.shiftright(h, 12 * level), F.lit(BUCKETS)).cast("int")


def take_by_hash(rows: DataFrame, budgets: dict[str, float], *, key: str = "key", ident: str = "id", weight: str = "w") -> DataFrame:
    """``rows`` with a boolean ``taken``: of each key the rows of the smallest hashes whose weights come nearest to its budget.

    Weights are summed by key and hash bucket; the bucket in which the budget ends is cut into finer buckets, and only the rows of
    the last of these are put in order. A greater budget takes every row that a smaller one takes. Sent to the driver: keys times
    :data:`BUCKETS` sums at most. Keys without a budget take nothing; null weights count as 0.
    """
    spark = rows.sparkSession
    # The hash's low bits place a row in the outer bucket, the next ones in the inner: the order is (outer, inner, hash).
    own = rows.withColumn("h", F.xxhash64(ident)).withColumn("b0", _level(F.col("h"), 0)).withColumn("b1", _level(F.col("h"), 1))
    cuts: dict[str, list[float]] = {}
    outer = own.groupBy(key, "b0").agg(F.sum(weight).alias("w")).collect()
    by_key: dict[str, dict[int, float]] = {}
    for r in outer:
        if r[key] in budgets:
            by_key.setdefault(r[key], {})[r["b0"]] = r["w"] or 0

    def cut(sums: dict[int, float], budget: float) -> tuple[int, float]:
        """The bucket in which the budget ends, and what is left of the budget there."""
        left = budget
        for b in range(BUCKETS):
            w = sums.get(b, 0)
            if left < w:
                return b, left
            left -= w
        return BUCKETS, left

    for k, sums in by_key.items():
        cuts[k] = list(cut(sums, budgets[k]))
    if not cuts:
        return rows.withColumn("taken", F.lit(False))
    first = spark.createDataFrame([(k, int(c[0])) for k, c in cuts.items()], f"{key} string, c0 int")
    marked = own.join(F.broadcast(first), key, "left")  # a row for each budget
    fine: dict[str, dict[int, float]] = {}
    for r in marked.filter("b0 = c0").groupBy(key, "b1").agg(F.sum(weight).alias("w")).collect():
        fine.setdefault(r[key], {})[r["b1"]] = r["w"] or 0
    second = []
    for k, (b, left) in cuts.items():
        c1, rest = cut(fine.get(k, {}), left) if b < BUCKETS else (BUCKETS, 0.0)
        second.append((k, int(c1), float(rest)))
    marked = marked.join(F.broadcast(spark.createDataFrame(second, f"{key} string, c1 int, rest double")), key, "left")
    edge = marked.filter("b0 = c0 and b1 = c1")
    order = Window.partitionBy(key).orderBy("h", ident).rowsBetween(Window.unboundedPreceding, 0)
    near = edge.withColumn("sum", F.sum(weight).over(order)).filter(F.col("sum") - F.col(weight) / 2 <= F.col("rest")).select(key, ident, F.lit(True).alias("near"))
    below = F.coalesce((F.col("b0") < F.col("c0")) | ((F.col("b0") == F.col("c0")) & (F.col("b1") < F.col("c1"))), F.lit(False))
    out = marked.join(near, [key, ident], "left").withColumn("taken", below | F.coalesce("near", F.lit(False)))
    return out.select(*rows.columns, "taken")
