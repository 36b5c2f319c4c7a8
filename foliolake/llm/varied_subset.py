"""Choosing a varied subset: a multi-attribute grid, taken in rounds. SQL only.

Every page lies in a cell of four grids: its series, the axis its direction leans to most, the same in a second frame, and both
axes together. Similar pages mostly lean the same way, so a large group of them crowds few cells. Pages are ranked by one hash
order within each cell; a page's round is the greatest of its ranks, each measured against the number of pages a cell of that grid
should give. The subset is the first ``k`` pages by (round, hash): a page of a crowded cell comes late, whichever grid it crowds.

A cell is never sorted whole: its pages are cut into ranges of the hash by their number, ranked within a range, and a range's first rank
is the count of the cell's pages before it. A cell with a third of all pages spreads over as many tasks as it has ranges.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolake.llm.thresholds import take_by_hash
from foliolake.runtime import materialize

DIM = 64
#: Pages of one cell and range of the hash, on average, that are put in order together; large cells that are broadcast at most.
RANGE_ROWS, MAX_BROADCAST = 50_000, 1_000_000
GRIDS = ("series_cell", "axis_cell", "frame_cell", "similar_cell")


def _usable(vector: str) -> Column:
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) == DIM) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _leaning(v: Column) -> Column:
    """The axis of the greatest absolute component, with its sign: 1..64 or -1..-64."""
    top = F.array_max(F.transform(v, lambda x, i: F.struct(F.abs(x).alias("a"), (-i).alias("i"), (x > 0).alias("up"))))
    return F.when(top["up"], 1 - top["i"]).otherwise(top["i"] - 1).cast("int")


def _turned(v: Column, by: int) -> Column:
    return F.concat(F.slice(v, by + 1, DIM - by), F.slice(v, 1, by))


def page_cells(vectors: DataFrame) -> DataFrame:
    """(page_id, series, h, series_cell, axis_cell, frame_cell, similar_cell) of each page whose latest row has a usable vector."""
    slim = vectors.filter("page_id is not null").select("page_id", "written_at", "series", "page_embeddings")
    v = F.col("page_embeddings")
    ok = slim.withColumn("ok", _usable("page_embeddings"))
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    # The common direction of all rows says nothing about a page: it is taken off.
    sized = ok.filter("ok").select(v.alias("v"), length.alias("l"))
    mean = sized.agg(*[F.avg(F.col("v")[i] / F.col("l")).alias(f"m{i}") for i in range(DIM)]).first()
    centre = F.array(*[F.lit(float(m or 0.0)) for m in mean])
    u = F.zip_with(F.transform(v, lambda x: x / F.col("l")), centre, lambda x, m: x - m)
    made = ok.withColumn("l", length).withColumn("u", F.when(F.col("ok"), u))
    frame = F.zip_with(F.zip_with(F.col("u"), _turned(F.col("u"), 17), lambda x, y: x + y), _turned(F.col("u"), 29), lambda x, y: x - y)
    made = made.select("page_id", "written_at", "series", "ok", _leaning(F.col("u")).alias("a"), _leaning(frame).alias("b"))
    key = F.regexp_replace(F.lower(F.coalesce("series", F.lit(""))), r"[^\p{L}\p{N}]+", "")
    latest = made.groupBy("page_id").agg(F.max(F.struct("written_at", "ok", "a", "b", key.alias("series"))).alias("x")).filter("x.ok")
    return latest.select(
        "page_id", "x.series", F.xxhash64("page_id", F.lit("order")).alias("h"), F.xxhash64("x.series").alias("series_cell"), F.col("x.a").cast("long").alias("axis_cell"),
        F.col("x.b").cast("long").alias("frame_cell"), (F.col("x.a") * 1000 + F.col("x.b")).cast("long").alias("similar_cell"),
    )


def _hash_ranges(cells: DataFrame, cell: str) -> tuple[DataFrame, DataFrame]:
    """(page_id, cell, h, b), (cell, b, before): the pages with their range of the hash, of which a cell has one for each
    :data:`RANGE_ROWS` pages, and the pages before a range in cells of several."""
    sizes = cells.groupBy(cell).agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > RANGE_ROWS)
    large = materialize(sizes.select(cell, F.ceil(F.col("size") / RANGE_ROWS).alias("ranges")), "large_cells")
    few = F.broadcast(large) if large.count() <= MAX_BROADCAST else large
    at = F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * F.coalesce("ranges", F.lit(1))).cast("long")
    own = cells.select("page_id", cell, "h").join(few, cell, "left").select("page_id", cell, "h", at.alias("b"), "ranges")
    counts = own.filter("ranges is not null").groupBy(cell, "b").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(cell).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    return own.drop("ranges"), counts.select(cell, "b", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))


def choose_varied(vectors: DataFrame, *, share: float = 0.01, k: int | None = None) -> DataFrame:
    """(page_id, series, series_cell, similar_cell, round) of exactly ``k`` pages (``share`` of the eligible ones unless given), or of all
    eligible pages if there are no more.

    Eligible: pages whose latest row has a usable vector. A null series is a series of its own; ways to write a series that differ in
    case, blanks and punctuation are one. Ties between equal rounds go by hash of the page. An empty table gives no rows.
    """
    cells = materialize(page_cells(vectors), "cells")
    count = cells.agg(F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(c).alias(c) for c in GRIDS]).first()
    n = count["n"]
    k = min(n, max(1, round(n * share)) if k is None else k) if n else 0
    # What a cell of a grid gives in a round; of a grid with more cells than pages are wanted, one.
    fair = {c: max(1.0, k / max(count[c], 1)) for c in GRIDS}

    places = {c: _hash_ranges(cells, c) for c in GRIDS}

    def ranked(cell: str, rounds: int) -> DataFrame:
        most = math.ceil(fair[cell] * rounds)
        own, before = places[cell]
        in_range = Window.partitionBy(cell, "b").orderBy("h", "page_id")
        first = own.withColumn("r", F.row_number().over(in_range)).filter(F.col("r") <= most)
        # A range's first rank is the number of pages in the cell's ranges before it.
        whole = first.join(before, [cell, "b"], "left").withColumn("r", F.col("r") + F.coalesce("before", F.lit(0))).filter(F.col("r") <= most)
        return whole.select("page_id", F.ceil(F.col("r") / fair[cell]).cast("long").alias(f"r_{cell}"))

    rounds = 2
    while True:
        both = cells.select("page_id", "series", "series_cell", "similar_cell")
        for c in GRIDS:
            both = both.join(ranked(c, rounds), "page_id")
        both = materialize(both.select("page_id", "series", "series_cell", "similar_cell", F.greatest(*[f"r_{c}" for c in GRIDS]).alias("round")), "ranked")
        levels = {r["round"]: r["n"] for r in both.groupBy("round").agg(F.count(F.lit(1)).alias("n")).collect()}
        if sum(levels.values()) >= k or rounds > n:
            break
        rounds *= 8
    last, below = 0, 0
    for last in sorted(levels):
        if below + levels[last] >= k:
            break
        below += levels[last]
    inner, edge = both.filter(F.col("round") < last), both.filter(F.col("round") == last)
    taken = take_by_hash(edge.withColumn("key", F.lit("edge")).withColumn("w", F.lit(1)), {"edge": k - below}, ident="page_id").filter("taken")
    return inner.unionByName(taken.select(*inner.columns))
