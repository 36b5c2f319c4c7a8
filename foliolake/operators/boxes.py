"""Per-page box operators: overlap joins and argmax assignment as joins on the page, and small greedy kernels over groups of Arrow columns.

A page holds a few dozen boxes, so a group never grows with the table; the kernels get a page's boxes only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolake.functions import geometry as G
from foliolake.operators.grouped import map_groups


def box_pairs(a: DataFrame, b: DataFrame, measure, *, page: str = "page", least: float = 0.0) -> DataFrame:
    """(page, a_id, b_id, value) of the boxes of one page whose measure is above ``least``. ``a``, ``b``: page, box_id, box."""
    x, y = a.select(page, F.col("box_id").alias("a_id"), F.col("box").alias("abox")), b.select(page, F.col("box_id").alias("b_id"), F.col("box").alias("bbox"))
    return x.join(y, page).withColumn("value", measure(F.col("abox"), F.col("bbox"))).filter(F.col("value") > least).select(page, "a_id", "b_id", "value")


def assign_best(pairs: DataFrame, *, page: str = "page") -> DataFrame:
    """Each b_id with the a_id of the greatest value; among equals the smaller a_id."""
    w = Window.partitionBy(page, "b_id").orderBy(F.desc("value"), "a_id")
    return pairs.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def assign_centre(panels: DataFrame, items: DataFrame, *, page: str = "page") -> DataFrame:
    """Each item with the first panel that holds its centre; null where none does."""
    p = panels.select(page, F.col("box_id").alias("panel_id"), F.col("box").alias("pbox"))
    hit = items.join(p, page, "left").withColumn("panel_id", F.when(G.holds_centre(F.col("pbox"), F.col("box")), F.col("panel_id")))
    return hit.groupBy(page, "box_id").agg(F.min("panel_id").alias("panel_id"))


def _iou(a: tuple[float, float, float, float], b: tuple[float, float, float, float]) -> float:
    iw = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    ih = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    if iw <= 0 or ih <= 0:
        return 0.0
    inter = iw * ih
    return inter / (a[2] * a[3] + b[2] * b[3] - inter)


def _boxes_of(c: dict[str, np.ndarray]) -> list[tuple[float, float, float, float]]:
    return list(zip(*(c[k].astype(float).tolist() for k in ("x", "y", "w", "h"))))


def keep_best(boxes: list, order: list[int], dropped) -> list[int]:
    """Greedy suppression: in the given order a box stays unless its overlap with one that stayed is ``dropped``."""
    kept: list[int] = []
    for i in order:
        if not any(dropped(_iou(boxes[i], boxes[k])) for k in kept):
            kept.append(i)
    return kept


def _types(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*columns).schema.fields)


def suppress(boxes: DataFrame, *, threshold: float = 0.25, by: tuple[str, ...] = ("page",)) -> DataFrame:
    """Non-maximum suppression within each group: (by..., box_id) of the boxes kept, ``rank`` in order of score. A box goes that overlaps
    one kept by the threshold or more; of equal scores the later box goes first. ``boxes``: by..., box_id, x, y, w, h, score."""

    def kernel(c: dict[str, np.ndarray], bounds: list[tuple[int, int]]) -> dict:
        b, score, at, rank = _boxes_of(c), c["score"].tolist(), [], []
        for lo, hi in bounds:
            order = sorted(range(lo, hi), key=lambda i: (score[i], i), reverse=True)
            kept = keep_best(b, order, lambda v: v >= threshold)
            at += kept
            rank += range(1, len(kept) + 1)
        return {k: c[k][at] for k in (*by, "box_id")} | {"rank": np.array(rank, np.int32)}

    return map_groups(boxes.select(*by, "box_id", "x", "y", "w", "h", "score"), list(by), ["box_id", "x", "y", "w", "h"], kernel, _types(boxes, [*by, "box_id"]) + ", rank int")


def suppress_tiled(boxes: DataFrame, *, tile: float, overlap: float, threshold: float = 0.25) -> DataFrame:
    """Suppression by label after detection on overlapping tiles: boxes are moved by their tile's offset first (``tile_x``, ``tile_y``)."""
    step = tile - overlap
    moved = boxes.withColumn("x", F.col("x") + F.col("tile_x") * step).withColumn("y", F.col("y") + F.col("tile_y") * step)
    return suppress(moved, threshold=threshold, by=("page", "label"))


def drop_repeats(boxes: DataFrame, priority: list[str], *, threshold: float = 0.95) -> DataFrame:
    """(page, box_id, label) without boxes that overlap, by more than the threshold, one of a label before theirs in ``priority`` (or, of
    one label, an earlier one); labels not named come last."""
    rank = F.lit(len(priority))
    for i, label in enumerate(priority):
        rank = F.when(F.col("label") == label, i).otherwise(rank)

    def kernel(c: dict[str, np.ndarray], bounds: list[tuple[int, int]]) -> dict:
        b = _boxes_of(c)
        at = [i for lo, hi in bounds for i in keep_best(b, list(range(lo, hi)), lambda v: v > threshold)]
        return {k: c[k][at] for k in ("page", "box_id", "label")}

    slim = boxes.select("page", "box_id", "label", "x", "y", "w", "h", rank.alias("_r"))
    return map_groups(slim, ["page"], ["_r", "box_id", "x", "y", "w", "h"], kernel, _types(boxes, ["page", "box_id", "label"]))


def greedy_match(a: DataFrame, b: DataFrame, *, least: float = 0.1) -> DataFrame:
    """One-to-one match of two box sets of each page by falling IoU (above ``least``; ties: smaller a_id, then b_id), with what is left
    over on either side: (page, a_id, b_id, iou, mask). mask: presence of box, text and geometry: 111 both, 101 only b, 010 only a."""
    both = a.select("page", "box_id", "x", "y", "w", "h", F.lit(0).alias("side")).unionByName(b.select("page", "box_id", "x", "y", "w", "h", F.lit(1).alias("side")))
    kind = a.schema["box_id"].dataType.simpleString()

    def kernel(c: dict[str, np.ndarray], bounds: list[tuple[int, int]]) -> dict:
        boxes, side, ids, pages = _boxes_of(c), c["side"].tolist(), c["box_id"].tolist(), c["page"]
        rows: list[tuple] = []
        for lo, hi in bounds:
            left, right = [i for i in range(lo, hi) if not side[i]], [i for i in range(lo, hi) if side[i]]
            pairs = sorted((-v, i, j) for i in left for j in right if (v := _iou(boxes[i], boxes[j])) > least)
            used: set[int] = set()
            for v, i, j in pairs:
                if i not in used and j not in used:
                    used |= {i, j}
                    rows.append((lo, ids[i], ids[j], -v, "111"))
            rows += [(lo, None, ids[j], 0.0, "101") for j in right if j not in used]
            rows += [(lo, ids[i], None, 0.0, "010") for i in left if i not in used]
        at, a_id, b_id, iou, mask = map(list, zip(*rows))
        made = pa.array(c["box_id"]).type
        return {"page": pages[at], "a_id": pa.array(a_id, made), "b_id": pa.array(b_id, made), "iou": np.array(iou), "mask": mask}

    return map_groups(both, ["page"], ["side", "box_id", "x", "y", "w", "h"], kernel, _types(a, ["page"]) + f", a_id {kind}, b_id {kind}, iou double, mask string")


def reading_order(boxes: DataFrame, *, rtl: bool = False, least: float = 0.25, page: str = "page") -> DataFrame:
    """``boxes`` with ``row_no`` and ``position``, both from 1: from the top, a box that overlaps the one before by more than ``least`` of
    the lesser height stays in its row; within a row by x. Pure windows over each page."""
    down = Window.partitionBy(page).orderBy("y", "box_id")
    b, prev = G.box(F.col("x"), F.col("y"), F.col("w"), F.col("h")), F.lag(F.struct("x", "y", "w", "h")).over(down)
    new = F.when(prev.isNull() | (G.vertical_overlap(prev, b) <= least), 1).otherwise(0)
    rows = boxes.withColumn("_new", new).withColumn("row_no", F.sum("_new").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    across = Window.partitionBy(page).orderBy("row_no", F.desc("x") if rtl else F.col("x"), "y", "box_id")
    return rows.withColumn("position", F.row_number().over(across)).drop("_new")


def next_panel(ordered: DataFrame, *, page: str = "page") -> DataFrame:
    """``next_id``: the box that follows in reading order; null for the last."""
    return ordered.withColumn("next_id", F.lead("box_id").over(Window.partitionBy(page).orderBy("position")))


def neighbours(boxes: DataFrame, *, least: float = 0.2, fallback: int = 2, page: str = "page") -> DataFrame:
    """(page, src, dst, relation): the nearest box to the left, right, above and below that overlaps by more than ``least``; a box without
    any is joined to its ``fallback`` nearest by centre (relation "near"). Of equals the smaller box goes first."""
    b = boxes.select(page, "box_id", G.box(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("b"))
    pairs = b.select(page, F.col("box_id").alias("src"), F.col("b").alias("p")).join(b.select(page, F.col("box_id").alias("dst"), F.col("b").alias("q")), page).filter("src != dst")
    dx = (F.col("q.x") + F.col("q.w") / 2) - (F.col("p.x") + F.col("p.w") / 2)
    dy = (F.col("q.y") + F.col("q.h") / 2) - (F.col("p.y") + F.col("p.h") / 2)
    pairs = pairs.withColumn("dx", dx).withColumn("dy", dy)
    p, q = F.col("p"), F.col("q")
    side = F.array(
        F.when((F.col("dx") < 0) & (G.vertical_overlap(p, q) > least), F.struct(F.lit("left").alias("relation"), (-F.col("dx")).alias("dist"))),
        F.when((F.col("dx") > 0) & (G.vertical_overlap(p, q) > least), F.struct(F.lit("right").alias("relation"), F.col("dx").alias("dist"))),
        F.when((F.col("dy") < 0) & (G.horizontal_overlap(p, q) > least), F.struct(F.lit("above").alias("relation"), (-F.col("dy")).alias("dist"))),
        F.when((F.col("dy") > 0) & (G.horizontal_overlap(p, q) > least), F.struct(F.lit("below").alias("relation"), F.col("dy").alias("dist"))),
    )
    near = F.struct(F.lit("near").alias("relation"), F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).alias("dist"))
    sides = F.filter(side, lambda s: s.isNotNull())
    has = F.max((F.size(sides) > 0).cast("int")).over(Window.partitionBy(page, "src"))
    long = pairs.withColumn("has", has).withColumn("s", F.explode(F.when(F.col("has") == 1, sides).otherwise(F.array(near)))).select(page, "src", "dst", "s.relation", "s.dist")
    rank = F.row_number().over(Window.partitionBy(page, "src", "relation").orderBy("dist", "dst"))
    return long.withColumn("rn", rank).filter((F.col("rn") == 1) | ((F.col("relation") == "near") & (F.col("rn") <= fallback))).select(page, "src", "dst", "relation")


def first_passing(boxes: DataFrame, passes: Column, *, fallback: int, page: str = "page") -> DataFrame:
    """The boxes that pass; where none of a page does, its ``fallback`` boxes of the highest score."""
    w = Window.partitionBy(page)
    rank = F.row_number().over(w.orderBy(F.desc("score"), "box_id"))
    marked = boxes.withColumn("_ok", passes).withColumn("_any", F.max(F.col("_ok").cast("int")).over(w)).withColumn("_rn", rank)
    return marked.filter(F.col("_ok") | ((F.col("_any") == 0) & (F.col("_rn") <= fallback))).drop("_ok", "_any", "_rn")


def link_speakers(balloons: DataFrame, characters: DataFrame, *, least: float = 0.1) -> DataFrame:
    """(page, balloon, character): the character of the greatest IoU with each balloon above ``least``, else the one whose centre is
    nearest; null on pages without characters."""
    c = characters.select("page", F.col("box_id").alias("character"), F.col("box").alias("cb"))
    j = balloons.select("page", F.col("box_id").alias("balloon"), F.col("box").alias("bb")).join(c, "page", "left")
    cx = lambda n: F.col(f"{n}.x") + F.col(f"{n}.w") / 2
    cy = lambda n: F.col(f"{n}.y") + F.col(f"{n}.h") / 2
    v = G.iou(F.col("bb"), F.col("cb"))
    far = F.sqrt((cx("bb") - cx("cb")) ** 2 + (cy("bb") - cy("cb")) ** 2)
    w = Window.partitionBy("page", "balloon").orderBy(F.desc(F.when(v > least, v).otherwise(0.0)), far.asc_nulls_last(), "character")
    return j.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("page", "balloon", "character")
