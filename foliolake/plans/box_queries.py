"""Panel geometry on synthesised boxes, with SQL: a page is an order, a box one of its lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliolake.functions import geometry as G
from foliolake.operators import boxes as B
from foliolake.runtime import table

C = F.col


def _boxes(spark, d):
    """page, box_id, x, y, w, h, score, label, box."""
    from pyspark.sql import Window

    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    li = table(spark, d, "lineitem").withColumn("box_id", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)))
    b = li.select(
        C("l_orderkey").alias("page"), "box_id", (C("l_quantity") * 10).alias("x"), (C("l_linenumber") * 40).cast("double").alias("y"),
        (20 + C("l_suppkey") % 80).cast("double").alias("w"), (20 + C("l_partkey") % 90).cast("double").alias("h"), (1 - C("l_discount") * 5).alias("score"), C("l_returnflag").alias("label"),
    )
    return b.withColumn("box", G.box(C("x"), C("y"), C("w"), C("h")))


def _sides(spark, d):
    b = _boxes(spark, d)
    return b.filter("box_id % 2 = 1"), b.filter("box_id % 2 = 0")


def iou_pairs(spark, d):
    a, b = _sides(spark, d)
    return B.box_pairs(a, b, lambda p, q: G.iou(p, q, eps=1e-6)).withColumn("value", F.round("value", 6))


def iota_assign(spark, d):
    a, b = _sides(spark, d)
    return B.assign_best(B.box_pairs(a, b, G.inside, least=0.05)).withColumn("value", F.round("value", 6))


def best_iou_assign(spark, d):
    a, b = _sides(spark, d)
    return B.assign_best(B.box_pairs(a, b, G.iou)).withColumn("value", F.round("value", 6))


def center_assign(spark, d):
    a, b = _sides(spark, d)
    return B.assign_centre(a, b)


def reading_order(spark, d):
    return B.reading_order(_boxes(spark, d)).select("page", "box_id", "row_no", "position")


def reading_order_rtl(spark, d):
    return B.next_panel(B.reading_order(_boxes(spark, d), rtl=True)).select("page", "box_id", "position", "next_id")


def neighbours(spark, d):
    return B.neighbours(_boxes(spark, d))


def composition_features(spark, d):
    b = _boxes(spark, d)
    f = G.composition(C("box"), F.lit(700.0), F.lit(420.0))
    return b.select("page", "box_id", F.transform(f, lambda x: F.round(x, 6)).alias("features"))


def box_clamp(spark, d):
    b = _boxes(spark, d)
    t = F.array(C("y") / 420 * 1000, C("x") / 700 * 1000, (C("y") + C("h")) / 420 * 1000, (C("x") + C("w")) / 700 * 1000)
    c = G.clamped(G.from_thousandths(t, F.lit(700.0), F.lit(420.0)), F.lit(500), F.lit(300))
    return b.select("page", "box_id", c["x"].alias("cx"), c["y"].alias("cy"), c["w"].alias("cw"), c["h"].alias("ch"))


def bbox_normalise(spark, d):
    b = _boxes(spark, d)
    none = F.lit(None).cast("array<double>")
    corners = F.when(C("box_id") % 3 == 0, F.array(C("x"), C("y"), C("x") + C("w"), C("y") + C("h"))).otherwise(none)
    xywh = F.when(C("box_id") % 3 == 1, F.array("x", "y", "w", "h")).otherwise(none)
    poly = F.when(C("box_id") % 3 == 2, F.array(F.array(C("x"), C("y")), F.array(C("x") + C("w"), C("y")), F.array(C("x") + C("w"), C("y") + C("h"))))
    n = G.any_box(corners, xywh, poly)
    return b.select("page", "box_id", *[F.round(n[k], 6).alias(f"n{k}") for k in "xywh"])


def nms(spark, d):
    return B.suppress(_boxes(spark, d).select("page", "box_id", "x", "y", "w", "h", "score"), threshold=0.05)


def tiled_nms(spark, d):
    b = _boxes(spark, d).withColumn("tile_x", C("box_id") % 2).withColumn("tile_y", F.lit(0))
    return B.suppress_tiled(b, tile=128, overlap=32, threshold=0.05)


def box_dedup(spark, d):
    return B.drop_repeats(_boxes(spark, d), ["R", "N", "A"], threshold=0.1)


def greedy_match(spark, d):
    a, b = _sides(spark, d)
    return B.greedy_match(a, b, least=0.02).withColumn("iou", F.round("iou", 6))


def balloon_linking(spark, d):
    a, b = _sides(spark, d)
    return B.link_speakers(b, a)


def fallback_boxes(spark, d):
    return B.first_passing(_boxes(spark, d), C("score") >= 0.9, fallback=2).select("page", "box_id", "score")


def page_geometry(spark, d):
    """Mean and population deviation of width, height, proportion and area of each page's boxes."""
    b = _boxes(spark, d)
    cols = {"w": C("w"), "h": C("h"), "aspect": F.when(C("h") > 1e-6, C("w") / C("h")), "area": C("w") * C("h")}
    return b.groupBy("page").agg(*[f(v).alias(f"{n}_{k}") for k, v in cols.items() for n, f in (("mean", lambda x: F.round(F.avg(x), 6)), ("std", lambda x: F.round(F.stddev_pop(x), 6)))])


def positional_pairing(spark, d):
    """The i-th box of one side with the i-th of the other, as far as both go."""
    from pyspark.sql import Window

    a, b = _sides(spark, d)
    w = Window.partitionBy("page").orderBy("y", "x", "box_id")
    x = a.select("page", C("box_id").alias("a_id"), F.row_number().over(w).alias("i"))
    y = b.select("page", C("box_id").alias("b_id"), F.row_number().over(w).alias("i"))
    return x.join(y, ["page", "i"])


_B = """b AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS box_id, l_quantity * 10 AS x, (l_linenumber * 40)::DOUBLE AS y, (20 + l_suppkey % 80)::DOUBLE AS w,
    (20 + l_partkey % 90)::DOUBLE AS h, 1 - l_discount * 5 AS score, l_returnflag AS label FROM lineitem)"""
_IW = "greatest(0, least(p.x + p.w, q.x + q.w) - greatest(p.x, q.x))"
_IH = "greatest(0, least(p.y + p.h, q.y + q.h) - greatest(p.y, q.y))"
_I = f"({_IW} * {_IH})"
_U = f"(p.w * p.h + q.w * q.h - {_I})"
_PQ = "FROM b p JOIN b q ON p.page = q.page AND p.box_id % 2 = 1 AND q.box_id % 2 = 0"
_VO = f"({_IH} / greatest(1e-6, least(p.h, q.h)))"
_HO = f"({_IW} / greatest(1e-6, least(p.w, q.w)))"
_ORDER = f"""WITH {_B}, l AS (SELECT *, lag(y) OVER d AS py, lag(h) OVER d AS ph FROM b WINDOW d AS (PARTITION BY page ORDER BY y, box_id)),
    n AS (SELECT *, CASE WHEN py IS NULL OR greatest(0, least(py + ph, y + h) - greatest(py, y)) / greatest(1e-6, least(ph, h)) <= 0.25 THEN 1 ELSE 0 END AS fresh FROM l),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY page ORDER BY y, box_id ROWS UNBOUNDED PRECEDING) AS row_no FROM n)"""


def _best(value: str, least: str) -> str:
    return f"""WITH {_B}, v AS (SELECT p.page, p.box_id AS a_id, q.box_id AS b_id, {value} AS value {_PQ}),
        r AS (SELECT *, row_number() OVER (PARTITION BY page, b_id ORDER BY value DESC, a_id) AS rn FROM v WHERE value > {least}) SELECT page, a_id, b_id, round(value, 6) AS value FROM r WHERE rn = 1"""


SQL = {
    "iou_pairs": f"WITH {_B} SELECT p.page, p.box_id AS a_id, q.box_id AS b_id, round({_I} / ({_U} + 1e-6), 6) AS value {_PQ} WHERE {_I} > 0",
    "iota_assign": _best(f"{_I} / (q.w * q.h)", "0.05"),
    "best_iou_assign": _best(f"{_I} / {_U}", "0"),
    "center_assign": f"""WITH {_B} SELECT q.page, q.box_id, min(p.box_id) AS panel_id FROM b q LEFT JOIN b p ON p.page = q.page AND p.box_id % 2 = 1
        AND q.x + q.w / 2 BETWEEN p.x AND p.x + p.w AND q.y + q.h / 2 BETWEEN p.y AND p.y + p.h WHERE q.box_id % 2 = 0 GROUP BY ALL""",
    "reading_order": _ORDER + " SELECT page, box_id, row_no, row_number() OVER (PARTITION BY page ORDER BY row_no, x, y, box_id) AS position FROM r",
    "reading_order_rtl": _ORDER
    + """, o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY row_no, x DESC, y, box_id) AS position FROM r)
        SELECT page, box_id, position, lead(box_id) OVER (PARTITION BY page ORDER BY position) AS next_id FROM o""",
    "neighbours": f"""WITH {_B}, m AS (SELECT p.page, p.box_id AS src, q.box_id AS dst, (q.x + q.w / 2) - (p.x + p.w / 2) AS dx, (q.y + q.h / 2) - (p.y + p.h / 2) AS dy, {_VO} AS vo, {_HO} AS ho
        FROM b p JOIN b q ON p.page = q.page AND p.box_id <> q.box_id),
        s AS (SELECT page, src, dst, 'left' AS relation, -dx AS dist FROM m WHERE dx < 0 AND vo > 0.2 UNION ALL SELECT page, src, dst, 'right', dx FROM m WHERE dx > 0 AND vo > 0.2
        UNION ALL SELECT page, src, dst, 'above', -dy FROM m WHERE dy < 0 AND ho > 0.2 UNION ALL SELECT page, src, dst, 'below', dy FROM m WHERE dy > 0 AND ho > 0.2),
        t AS (SELECT * FROM s UNION ALL SELECT page, src, dst, 'near', sqrt(dx * dx + dy * dy) FROM m WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.page = m.page AND s.src = m.src)),
        r AS (SELECT *, row_number() OVER (PARTITION BY page, src, relation ORDER BY dist, dst) AS rn FROM t)
        SELECT page, src, dst, relation FROM r WHERE rn = 1 OR (relation = 'near' AND rn <= 2)""",
    "composition_features": f"""WITH {_B} SELECT page, box_id, list_transform([w / greatest(h, 1e-6), w * h / (700.0 * 420.0)::DOUBLE, (x + w / 2) / 700::DOUBLE, (y + h / 2) / 420::DOUBLE, w / 700::DOUBLE, h / 420::DOUBLE,
        x / 700::DOUBLE, y / 420::DOUBLE], lambda v: round(v, 6)) AS features FROM b""",
    "box_clamp": f"""WITH {_B}, t AS (SELECT page, box_id, x::DOUBLE / 700 * 1000 / 1000 * 700 AS x1, y::DOUBLE / 420 * 1000 / 1000 * 420 AS y1, (x::DOUBLE + w::DOUBLE) / 700 * 1000 / 1000 * 700 AS x2, (y::DOUBLE + h::DOUBLE) / 420 * 1000 / 1000 * 420 AS y2 FROM b),
        c AS (SELECT page, box_id, greatest(trunc(x1), 0) AS x1, greatest(trunc(y1), 0) AS y1, least(trunc(x1 + (x2 - x1)), 500) AS x2, least(trunc(y1 + (y2 - y1)), 300) AS y2 FROM t)
        SELECT page, box_id, x1 AS cx, y1 AS cy, greatest(x2 - x1, 1) AS cw, greatest(y2 - y1, 1) AS ch FROM c""",
    "bbox_normalise": f"""WITH {_B} SELECT page, box_id, round(greatest(x, 0), 6) AS nx, round(greatest(y, 0), 6) AS ny, round(greatest(w, 1), 6) AS nw, round(greatest(h, 1), 6) AS nh FROM b""",
    "fallback_boxes": f"""WITH {_B}, r AS (SELECT *, max((score >= 0.9)::INT) OVER (PARTITION BY page) AS good, row_number() OVER (PARTITION BY page ORDER BY score DESC, box_id) AS rn FROM b)
        SELECT page, box_id, score FROM r WHERE score >= 0.9 OR (good = 0 AND rn <= 2)""",
    "page_geometry": f"""WITH {_B} SELECT page, round(avg(w), 6) AS mean_w, round(stddev_pop(w), 6) AS std_w, round(avg(h), 6) AS mean_h, round(stddev_pop(h), 6) AS std_h,
        round(avg(w / h), 6) AS mean_aspect, round(stddev_pop(w / h), 6) AS std_aspect, round(avg(w * h), 6) AS mean_area, round(stddev_pop(w * h), 6) AS std_area FROM b GROUP BY page""",
    "positional_pairing": f"""WITH {_B}, r AS (SELECT *, row_number() OVER (PARTITION BY page, box_id % 2 ORDER BY y, x, box_id) AS i FROM b)
        SELECT p.page, p.i, p.box_id AS a_id, q.box_id AS b_id FROM r p JOIN r q ON p.page = q.page AND p.i = q.i AND p.box_id % 2 = 1 AND q.box_id % 2 = 0""",
    "balloon_linking": f"""WITH {_B}, v AS (SELECT q.page, q.box_id AS balloon, p.box_id AS character, {_I} / {_U} AS v,
        sqrt(pow((q.x + q.w / 2) - (p.x + p.w / 2), 2) + pow((q.y + q.h / 2) - (p.y + p.h / 2), 2)) AS far FROM b q LEFT JOIN b p ON p.page = q.page AND p.box_id % 2 = 1 WHERE q.box_id % 2 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY page, balloon ORDER BY CASE WHEN v > 0.1 THEN v ELSE 0 END DESC, far NULLS LAST, character) AS rn FROM v) SELECT page, balloon, character FROM r WHERE rn = 1""",
}

QUERIES = {
    f.__name__: f
    for f in (
        iou_pairs, iota_assign, best_iou_assign, center_assign, reading_order, reading_order_rtl, neighbours, composition_features, box_clamp, bbox_normalise, nms,
        tiled_nms, box_dedup, greedy_match, balloon_linking, fallback_boxes, page_geometry, positional_pairing,
    )
}
