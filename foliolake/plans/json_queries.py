"""Page documents: repair, extraction and text views."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliolake.functions import json_repair as R
from foliolake.functions import page_text as T
from foliolake.operators import label_rules
from foliolake.operators.nested_flatten import fixed_shape
from foliolake.runtime import table

C = F.col


def _pages(spark, d):
    docs = table(spark, d, "vlm_docs").select("record_id", "doc").filter("doc is not null").dropDuplicates(["record_id"])
    return T.pages(fixed_shape(docs.select("record_id", R.repaired(C("doc")).alias("doc"))), C("doc"))


def _panels(spark, d):
    return _pages(spark, d).select("record_id", F.posexplode("panels").alias("panel", "p"))


def json_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


def json_repair(spark, d):
    """Documents that a strict parser refuses, repaired."""
    docs = table(spark, d, "vlm_docs").select("record_id", "doc").dropDuplicates(["record_id"])
    bad = docs.filter(F.try_parse_json("doc").isNull() & C("doc").isNotNull())
    return bad.select("record_id", R.repaired(C("doc")).alias("doc"))


def junk_key_strip(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat(F.lit('{"BBox": [1, 2], "inner": {"polygon": 1, "kept": '), C("props"), F.lit("}}")).alias("doc"))
    return e.select("event_id", R.without_keys(C("doc")).alias("doc"))


def vlm_panel_text(spark, d):
    return _panels(spark, d).select("record_id", "panel", T.panel_text(C("p")).alias("text"))


def vlm_dialogue_lines(spark, d):
    return _panels(spark, d).select("record_id", "panel", F.posexplode(T.dialogue_lines(C("p"))).alias("line_no", "line"))


def vlm_preview(spark, d):
    return _pages(spark, d).select("record_id", T.preview(C("panels")).alias("preview"))


def vlm_text_categories(spark, d):
    p = _panels(spark, d).select(*[T.bucket(C("p"), k).alias(k) for k in ("dialogue", "narration", "sfx")])
    p = p.select(T.category(C("dialogue"), C("narration"), C("sfx")).alias("category"), *[T.total_length(C(k)).alias(k) for k in ("dialogue", "narration", "sfx")])
    return p.groupBy("category").agg(F.count(F.lit(1)).alias("n"), *[F.sum(k).alias(f"{k}_chars") for k in ("dialogue", "narration", "sfx")])


def vlm_sequences(spark, d):
    p = _pages(spark, d)
    return p.select("record_id", *[T.sequence_text(p, s).alias(s) for s in ("all_text", "overall_summary", "summary_plot")])


def vlm_page_types(spark, d):
    """Rule labels over the documents' own words."""
    p = _pages(spark, d)
    p = p.select("record_id", T.corpus(p).alias("corpus"), F.size("panels").alias("panels"), F.lit(0.5).alias("pos_share"), F.lit(None).cast("double").alias("text_coverage"))
    return label_rules.score_labels(p).select("record_id", "page_type", "confidence")


SQL = {"json_extract": "SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events"}

QUERIES = {f.__name__: f for f in (json_extract, json_repair, junk_key_strip, vlm_panel_text, vlm_dialogue_lines, vlm_preview, vlm_text_categories, vlm_sequences, vlm_page_types)}
