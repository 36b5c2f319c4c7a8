"""Windows over pages of a book: positions, blocks, runs, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def position_share(df: DataFrame, book: list[str], order: list[Column]) -> DataFrame:
    """``position`` from 1, ``n_pages`` and ``pos_share`` = (position - 1) / max(1, n - 1), in a total order."""
    w = Window.partitionBy(*book)
    out = df.withColumn("position", F.row_number().over(w.orderBy(*order))).withColumn("n_pages", F.count(F.lit(1)).over(w))
    return out.withColumn("pos_share", (F.col("position") - 1) / F.greatest(F.lit(1), F.col("n_pages") - 1))


def ends(df: DataFrame) -> DataFrame:
    """``page_end``: cover for the first page, back_cover for the last of several, null between (after :func:`position_share`)."""
    return df.withColumn("page_end", F.when(F.col("position") == 1, "cover").when(F.col("position") == F.col("n_pages"), "back_cover"))


def blocks(df: DataFrame, group: list[str], page: str) -> DataFrame:
    """(group..., page_start, page_end, n): runs of consecutive page numbers. A number that repeats ends a run, as does a gap."""
    w = Window.partitionBy(*group).orderBy(page)
    new = F.when(F.col(page) == F.lag(page).over(w) + 1, 0).otherwise(1)
    runs = df.filter(F.col(page).isNotNull()).withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*group, "_run").agg(F.min(page).alias("page_start"), F.max(page).alias("page_end"), F.count(F.lit(1)).alias("n")).drop("_run")


def expand(segments: DataFrame, group: list[str], *, label: str, precedence: list[str]) -> DataFrame:
    """(group..., page, label): every page of every block; where blocks overlap, the label that stands last in ``precedence`` wins."""
    rank = F.lit(-1)
    for i, name in enumerate(precedence):
        rank = F.when(F.col(label) == name, i).otherwise(rank)
    pages = segments.filter("page_start <= page_end").select(*group, label, F.explode(F.sequence("page_start", "page_end")).alias("page"))
    return pages.groupBy(*group, "page").agg(F.max(F.struct(rank.alias("r"), F.col(label).alias("l")))["l"].alias(label))


def label_runs(df: DataFrame, group: list[str], order: list[str], label: str) -> DataFrame:
    """(group..., run, label, first and last of the first order column, n): runs of equal labels; null is a label like any other."""
    w = Window.partitionBy(*group).orderBy(*order)
    same = F.col(label).eqNullSafe(F.lag(label).over(w)) & (F.row_number().over(w) > 1)
    runs = df.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*group, "run", label).agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count(F.lit(1)).alias("n"))


def ranked(df: DataFrame, group: list[str], order: list[str], *, name: str = "_rn") -> DataFrame:
    """``df`` with each row's place in its group from 0, in a total order, however large a group is.

    Rows are laid out by range of (group, order), so a group with a third of all rows spreads over as many tasks as it fills. A row's
    place is its place in its range plus the group's rows in the ranges before: a count for each group and range.
    """
    from foliolake.runtime import materialize

    spread = df.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id())
    laid = materialize(spread, "ranges")
    counts = laid.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    starts = starts.toDF(*[f"_g{i}" for i in range(len(group))], "_at", "_start")
    local = laid.withColumn("_local", F.row_number().over(Window.partitionBy("_range", *group).orderBy(*order)) - 1)
    on = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)] + [F.col("_range") == F.col("_at")]
    return local.join(starts, on).select(*df.columns, (F.col("_local") + F.col("_start")).alias(name))


def chunks(df: DataFrame, group: list[str], order: list[str], size: int) -> DataFrame:
    """``chunk`` and ``slot`` from 0: consecutive pieces of ``size`` rows that never cross a group."""
    return ranked(df, group, order).withColumn("chunk", F.floor(F.col("_rn") / size)).withColumn("slot", F.col("_rn") % size).drop("_rn")


def sliding(df: DataFrame, group: list[str], order: list[str], *, size: int, stride: int) -> DataFrame:
    """One row for each row and window it falls in: windows of ``size`` rows every ``stride`` rows, full ones and the last."""
    rn = ranked(df, group, order)
    sizes = rn.groupBy(*group).agg((F.max("_rn") + 1).alias("_n")).toDF(*[f"_g{i}" for i in range(len(group))], "_n")
    on = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    last = F.greatest(F.ceil((F.col("_n") - size) / stride), F.lit(0))
    lo = F.greatest(F.ceil((F.col("_rn") - size + 1) / stride), F.lit(0))
    hi = F.least(F.floor(F.col("_rn") / stride), last)
    both = rn.join(sizes, on).select(*rn.columns, "_n")
    hit = both.withColumn("_lo", lo.cast("int")).withColumn("_hi", hi.cast("int")).filter("_lo <= _hi")
    return hit.withColumn("window", F.explode(F.sequence("_lo", "_hi"))).withColumn("slot", F.col("_rn") - F.col("window") * stride).drop("_rn", "_n", "_lo", "_hi")
