"""Scalar functions, star rows, zero-shot scores and reports, with SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from foliolake.functions import json_repair as R
from foliolake.functions import scalars as S
from foliolake.functions.vlm_json import panel_list, panels_of, read_doc
from foliolake.operators import hooks
from foliolake.operators.boxes import reading_order
from foliolake.operators.nested_flatten import fixed_shape, flatten_pages
from foliolake.plans.box_queries import _B, _boxes
from foliolake.plans.pipeline_queries import _length_engine
from foliolake.plans.relational_queries import _labels
from foliolake.runtime import spread, table

C = F.col


def scalar_maps(spark, d):
    lab = table(spark, d, "page_labels").distinct()
    return lab.select(
        "page_id", "labeled_at", "page_type", S.class_number(C("page_type")).alias("number"), S.class_name(S.class_number(C("page_type"))).alias("name"), S.on_date(C("labeled_at"), "2024-0").alias("early_2024"),
        S.ceil_to(C("page_id"), 16).alias("padded"), S.hamming(C("page_id"), F.lit(1023)).alias("bits"),
    )


def modality_masks(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", S.modality_mask(C("lang").isNotNull(), C("text"), C("n_chars") > 0).alias("mask"))


def epoch_times(spark, d):
    return table(spark, d, "events").select("event_id", S.from_epoch(C("event_id") * 3600).cast("timestamp_ntz").alias("at"), S.ocr_confidence(C("value") - 20).alias("confidence"))


def permutation_edges(spark, d):
    return S.permutation_edges(reading_order(_boxes(spark, d)), ["page"], "position", "box_id")


def document_names(spark, d):
    p = table(spark, d, "page_vectors").select("manifest_path").distinct()
    return p.select("manifest_path", S.document_name(C("manifest_path")).alias("document"), S.detector_id(F.lit("set"), C("manifest_path")).alias("detector_id"))


def probe_panels(spark, d):
    """Where the panels of wrapped documents are found."""
    e = table(spark, d, "events").select("event_id", F.element_at(F.array(F.lit('{"panels": [1]}'), F.lit('{"result": {"panels": [2]}}'), F.lit('{"page": {"panels": [3]}}'), F.lit('{"x": 1}')), (C("event_id") % 4 + 1).cast("int")).alias("doc"))
    return e.groupBy(S.probe(C("doc")).alias("panels")).agg(F.count(F.lit(1)).alias("n"))


def speech_lengths(spark, d):
    """Length of speaker lines by kind of speech."""
    docs = table(spark, d, "vlm_docs").select("record_id", "doc").filter("doc is not null").dropDuplicates(["record_id"])
    docs = fixed_shape(docs.select("record_id", R.repaired(C("doc")).alias("doc")))
    j = docs.select(F.from_json("doc", "panels array<struct<speakers:array<struct<dialogue:string,speech_type:string>>>>").alias("p"))
    s = j.select(F.explode("p.panels").alias("p")).select(F.explode("p.speakers").alias("s")).filter("s.dialogue is not null")
    return s.groupBy(S.speech_kind(F.coalesce("s.speech_type", F.lit(""))).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("s.dialogue")).alias("chars"))


def star_summary(spark, d):
    """The star of pages, panels, texts and lines, summed by page in plain SQL."""
    flatten_pages(table(spark, d, "vlm_docs")).distinct().createOrReplaceTempView("_star_flat")
    return spark.sql("""SELECT kind, count(*) AS n, count(DISTINCT record_id) AS pages, round(avg(length(content)), 6) AS mean_length FROM _star_flat GROUP BY kind""")


def last_panel_terms(spark, d):
    """Which of some terms the last panel of each document names; the first in order, else a default."""
    terms = ["clock", "lantern", "pistol", "mask", "letter"]
    docs = table(spark, d, "vlm_docs").select("record_id", "doc").filter("doc is not null").dropDuplicates(["record_id"])

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for pdf in batches:
            rows = []
            for rid, doc in zip(pdf["record_id"], pdf["doc"]):
                page = read_doc(doc)
                panels = panels_of(panel_list(page)[1]) if page is not None else []
                if panels:
                    rows.append((rid, json.dumps(panels[-1], ensure_ascii=False).lower()))
            yield pd.DataFrame(rows, columns=["record_id", "panel"])

    t = spread(docs).mapInPandas(last, "record_id long, panel string")
    hit = F.filter(F.array(*[F.lit(x) for x in terms]), lambda x: F.contains(C("panel"), x))
    return t.groupBy(F.coalesce(F.try_element_at(hit, F.lit(1)), F.lit("unspecified object")).alias("term")).agg(F.count(F.lit(1)).alias("n"))


def panels_per_page(spark, d):
    n = table(spark, d, "coco_images").select("image_id", "rcnn_panels").distinct().filter("rcnn_panels is not null")
    return n.agg(F.round(F.avg("rcnn_panels"), 6).alias("mean"), F.median("rcnn_panels").alias("median"), F.min("rcnn_panels").alias("least"), F.max("rcnn_panels").alias("greatest"), F.count(F.lit(1)).alias("n"))


def top_resolutions(spark, d):
    r = table(spark, d, "coco_images").filter("width is not null").groupBy("width", "height").agg(F.countDistinct("image_id").alias("n"))
    return r.orderBy(F.desc("n"), "width", "height").limit(5)


def failure_report(spark, d):
    """Failures of an engine run by kind of error."""
    res = hooks.run_engine(table(spark, d, "documents").select("doc_id", "text"), _length_engine, "n_words int, first string", key="doc_id")
    return res.groupBy("status", F.regexp_extract("error", r"^([^:]*)", 1).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def zero_shot_pivot(spark, d):
    """Stub class scores of texts as a map, pivoted to columns, the best as label."""
    classes = ("story", "credits", "cover")
    t = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    raw = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), (F.length("text") % (7 + i) + 1).cast("double"))])
    total = F.aggregate(F.map_values(raw), F.lit(0.0), lambda a, x: a + x)
    p = t.select("doc_id", F.transform_values(raw, lambda k, v: F.round(v / total, 3)).alias("p"))
    best = F.array_max(F.array(*[F.struct(C("p")[c].alias("s"), F.lit(-i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(classes)]))["c"]
    return p.select("doc_id", *[C("p")[c].alias(f"p_{c}") for c in classes], best.alias("label"))


def label_export(spark, d):
    """Label map with class numbers; classes without a number are left out."""
    return _labels(spark, d).select("page_id", "page_type", S.class_number(C("page_type")).alias("number")).filter("number is not null")


_CLASSES = "['advertisement', 'cover', 'story', 'textstory', 'first-page', 'credits', 'art', 'text', 'back_cover']"
_ORDERED = f"""WITH {_B}, l AS (SELECT *, lag(y) OVER d AS py, lag(h) OVER d AS ph FROM b WINDOW d AS (PARTITION BY page ORDER BY y, box_id)),
    n AS (SELECT *, CASE WHEN py IS NULL OR greatest(0, least(py + ph, y + h) - greatest(py, y)) / greatest(1e-6, least(ph, h)) <= 0.25 THEN 1 ELSE 0 END AS fresh FROM l),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY page ORDER BY y, box_id ROWS UNBOUNDED PRECEDING) AS row_no FROM n)"""

SQL = {
    "scalar_maps": f"""SELECT DISTINCT page_id, labeled_at, page_type, list_position({_CLASSES}, page_type) - 1 AS number, CASE WHEN list_contains({_CLASSES}, page_type) THEN page_type END AS name,
        starts_with(labeled_at::VARCHAR, '2024-0') AS early_2024, ((page_id + 15) // 16) * 16 AS padded, bit_count(xor(page_id, 1023)) AS bits FROM (SELECT DISTINCT * FROM page_labels)""",
    "modality_masks": "SELECT doc_id, [(lang IS NOT NULL)::INT, coalesce(trim(text) <> '', false)::INT, coalesce(n_chars > 0, false)::INT]::DOUBLE[] AS mask FROM documents",
    "epoch_times": "SELECT event_id, make_timestamp(event_id * 3600 * 1000000) AS at, greatest((value - 20) / 100, 0) AS confidence FROM events",
    "permutation_edges": _ORDERED + """, o AS (SELECT page, box_id, row_number() OVER (PARTITION BY page ORDER BY row_no, x, y, box_id) AS position FROM r),
        e AS (SELECT page, box_id AS src, lead(box_id) OVER (PARTITION BY page ORDER BY position) AS dst FROM o) SELECT * FROM e WHERE dst IS NOT NULL""",
    "document_names": r"SELECT manifest_path, replace(replace(replace(manifest_path, '/', '_'), '\', '_'), ':', '_') || '.json' AS document, 'set_' || regexp_replace(manifest_path, '\.[^.]+$', '') AS detector_id FROM (SELECT DISTINCT manifest_path FROM page_vectors)",
    "probe_panels": "SELECT CASE event_id % 4 WHEN 0 THEN '[1]' WHEN 1 THEN '[2]' WHEN 2 THEN '[3]' END AS panels, count(*) AS n FROM events GROUP BY 1",
    "panels_per_page": "SELECT round(avg(rcnn_panels), 6) AS mean, median(rcnn_panels) AS median, min(rcnn_panels) AS least, max(rcnn_panels) AS greatest, count(*) AS n FROM (SELECT DISTINCT image_id, rcnn_panels FROM coco_images WHERE rcnn_panels IS NOT NULL)",
    "top_resolutions": "SELECT width, height, count(DISTINCT image_id) AS n FROM coco_images WHERE width IS NOT NULL GROUP BY ALL ORDER BY n DESC, width, height LIMIT 5",
    "zero_shot_pivot": """WITH s AS (SELECT doc_id, (length(coalesce(text, '')) % 7 + 1)::DOUBLE AS a, (length(coalesce(text, '')) % 8 + 1)::DOUBLE AS b, (length(coalesce(text, '')) % 9 + 1)::DOUBLE AS c FROM documents),
        p AS (SELECT doc_id, round(a / (a + b + c), 3) AS p_story, round(b / (a + b + c), 3) AS p_credits, round(c / (a + b + c), 3) AS p_cover FROM s)
        SELECT *, CASE WHEN p_story >= p_credits AND p_story >= p_cover THEN 'story' WHEN p_credits >= p_cover THEN 'credits' ELSE 'cover' END AS label FROM p""",
    "failure_report": """SELECT CASE WHEN blank THEN 'failed' ELSE 'ok' END AS status, CASE WHEN blank THEN 'ValueError' END AS kind, count(*) AS n FROM (SELECT
        trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(160) || chr(12288)) = '' AS blank FROM documents) GROUP BY ALL""",
    "label_export": f"""SELECT page_id, page_type, list_position({_CLASSES}, page_type) - 1 AS number FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY labeled_at DESC NULLS LAST, page_type DESC NULLS LAST) AS rn FROM page_labels)
        WHERE rn = 1 AND list_contains({_CLASSES}, page_type)""",
}

QUERIES = {
    f.__name__: f
    for f in (
        scalar_maps, modality_masks, epoch_times, permutation_edges, document_names, probe_panels, speech_lengths, star_summary, last_panel_terms, panels_per_page,
        top_resolutions, failure_report, zero_shot_pivot, label_export,
    )
}
