"""Boxes as column expressions. A box is a struct x, y, w, h in pixels unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x, y, w, h) -> Column:
    """Struct x, y, w, h of doubles."""
    parts = dict(x=x, y=y, w=w, h=h)
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast("double").alias(k) for k, v in parts.items()])


def from_corners(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return box(x1, y1, x2 - x1, y2 - y1)


def from_centre(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return box(cx - w / 2, cy - h / 2, w, h)


def from_thousandths(b: Column, width: Column, height: Column) -> Column:
    """[y1, x1, y2, x2] in thousandths of the page, as a box in pixels."""
    return from_corners(b[1] / 1000 * width, b[0] / 1000 * height, b[3] / 1000 * width, b[2] / 1000 * height)


def from_polygon(points: Column) -> Column:
    """Bounding box of an array of [x, y]."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return from_corners(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def scaled(b: Column, sx: Column, sy: Column) -> Column:
    return box(b["x"] * sx, b["y"] * sy, b["w"] * sx, b["h"] * sy)


def clamped(b: Column, width: Column, height: Column) -> Column:
    """The part of a box on its page, whole pixels towards zero, at least one pixel wide and high."""
    x1, y1 = F.greatest(b["x"].cast("int"), F.lit(0)), F.greatest(b["y"].cast("int"), F.lit(0))
    x2, y2 = F.least((b["x"] + b["w"]).cast("int"), width.cast("int")), F.least((b["y"] + b["h"]).cast("int"), height.cast("int"))
    return box(x1, y1, F.greatest(x2 - x1, F.lit(1)), F.greatest(y2 - y1, F.lit(1)))


def area(b: Column) -> Column:
    return b["w"] * b["h"]


def centre(b: Column) -> Column:
    return F.struct((b["x"] + b["w"] / 2).alias("cx"), (b["y"] + b["h"] / 2).alias("cy"))


def _side(lo_a: Column, len_a: Column, lo_b: Column, len_b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(lo_a + len_a, lo_b + len_b) - F.greatest(lo_a, lo_b))


def intersection(a: Column, b: Column) -> Column:
    return _side(a["x"], a["w"], b["x"], b["w"]) * _side(a["y"], a["h"], b["y"], b["h"])


def iou(a: Column, b: Column, *, eps: float = 0.0) -> Column:
    """Intersection over union: with ``eps`` added to the union, or 0 where the union is empty."""
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return inter / (union + eps) if eps else F.when(union > 0, inter / union).otherwise(0.0)


def inside(a: Column, b: Column) -> Column:
    """Share of ``b`` that lies in ``a``."""
    return F.when(area(b) > 0, intersection(a, b) / area(b)).otherwise(0.0)


def vertical_overlap(a: Column, b: Column) -> Column:
    """Shared height over the lesser height."""
    return _side(a["y"], a["h"], b["y"], b["h"]) / F.greatest(F.lit(1e-6), F.least(a["h"], b["h"]))


def horizontal_overlap(a: Column, b: Column) -> Column:
    return _side(a["x"], a["w"], b["x"], b["w"]) / F.greatest(F.lit(1e-6), F.least(a["w"], b["w"]))


def holds_centre(outer: Column, inner: Column) -> Column:
    """True where the centre of ``inner`` lies in ``outer``, edges included."""
    cx, cy = inner["x"] + inner["w"] / 2, inner["y"] + inner["h"] / 2
    return cx.between(outer["x"], outer["x"] + outer["w"]) & cy.between(outer["y"], outer["y"] + outer["h"])


def composition(b: Column, width: Column, height: Column) -> Column:
    """[aspect, area share, cx, cy, width share, height share, x share, y share] of a box on its page."""
    c = centre(b)
    return F.array(b["w"] / F.greatest(b["h"], F.lit(1e-6)), area(b) / (width * height), c["cx"] / width, c["cy"] / height, b["w"] / width, b["h"] / height, b["x"] / width, b["y"] / height)


def composition_pixels(b: Column, width: Column, height: Column) -> Column:
    """Seven features of a box in pixels: [aspect, 1 without a height; area share; 0; 0; 0; cx; cy]."""
    c, zero = centre(b), F.lit(0.0)
    return F.array(F.when(b["h"] > 0, b["w"] / b["h"]).otherwise(1.0), area(b) / (width * height), zero, zero, zero, c["cx"] / width, c["cy"] / height)


def composition_thousandths(b: Column, number: Column, most: Column) -> Column:
    """Seven features of [y1, x1, y2, x2] in thousandths: as :func:`composition_pixels`, with the panel's number from 1 as a share of the
    panels there may be in the third place."""
    w, h, zero = (b[3] - b[1]) / 1000, (b[2] - b[0]) / 1000, F.lit(0.0)
    share = (number - 1) / F.greatest(most - 1, F.lit(1))
    return F.array(F.when(h > 0, w / h).otherwise(1.0), w * h, share, zero, zero, (b[1] + b[3]) / 2000, (b[0] + b[2]) / 2000)


def any_box(corners: Column, xywh: Column, polygon: Column) -> Column:
    """The first encoding that is there, as a box of at least one pixel at non-negative places."""
    b = F.coalesce(
        F.when(F.size(corners) == 4, from_corners(corners[0], corners[1], corners[2], corners[3])),
        F.when(F.size(xywh) == 4, box(xywh[0], xywh[1], xywh[2], xywh[3])),
        F.when(F.size(polygon) > 0, from_polygon(polygon)),
    )
    one, zero = F.lit(1.0), F.lit(0.0)
    return F.when(b.isNotNull(), box(F.greatest(b["x"], zero), F.greatest(b["y"], zero), F.greatest(b["w"], one), F.greatest(b["h"], one)))
