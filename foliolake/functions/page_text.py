"""Text views of page documents in the fixed shape (panels, description, text_content, ...), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PANEL = "struct<description:string,caption:string,text_content:string,speakers:string>"


def _text(raw: Column) -> Column:
    """A string, or a list of strings joined by blanks."""
    joined = F.array_join(F.from_json(raw, "array<string>"), " ")
    return F.trim(F.when(F.startswith(raw, F.lit("[")), F.coalesce(joined, raw)).otherwise(raw))


def pages(docs: DataFrame, doc: Column) -> DataFrame:
    """record_id, overall_summary, summary_text, characters, panels (array of structs; an object's panels in its order) of the documents
    that parse; panels a document doesn't have are an empty array."""
    j = docs.select("record_id", F.from_json(doc, "canonical_id string, overall_summary string, summary string, panels string, image_path string").alias("p")).filter("p is not null")
    raw = F.col("p.panels")
    as_list, as_map = F.from_json(raw, f"array<{_PANEL}>"), F.map_values(F.from_json(raw, f"map<string,{_PANEL}>"))
    listed = F.when(F.startswith(raw, F.lit("[")), as_list).when(F.startswith(raw, F.lit("{")), as_map)
    plot = F.get_json_object("p.summary", "$.plot")
    return j.select(
        "record_id", F.col("p.canonical_id").alias("canonical_id"), F.col("p.image_path").alias("image_path"), F.col("p.overall_summary").alias("overall_summary"),
        F.when(F.startswith("p.summary", F.lit("{")), plot).otherwise(F.col("p.summary")).alias("summary_text"),
        F.filter(F.coalesce(listed, F.array().cast(f"array<{_PANEL}>")), lambda x: x.isNotNull()).alias("panels"),
    )


def items(panel: Column) -> Column:
    """text_content as array<struct<text, speaker>>, empty unless it is a list of objects."""
    raw = panel["text_content"]
    return F.coalesce(F.when(F.startswith(raw, F.lit("[")), F.from_json(raw, "array<struct<text:string,speaker:string>>")), F.array().cast("array<struct<text:string,speaker:string>>"))


def panel_text(panel: Column) -> Column:
    """Description and texts joined by blanks."""
    texts = F.transform(items(panel), lambda t: _text(t["text"]))
    parts = F.concat(F.array(_text(panel["description"])), texts)
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), " ")


def dialogue_lines(panel: Column) -> Column:
    """"speaker: text", or the text alone."""
    lines = F.transform(F.filter(items(panel), lambda t: _text(t["text"]) != ""), lambda t: F.concat_ws(": ", F.nullif(_text(t["speaker"]), F.lit("")), _text(t["text"])))
    return lines


def preview(panels: Column, *, n: int = 4, length: int = 500) -> Column:
    """The first panels' texts joined by " | ", cut to a length that ends in three dots."""
    texts = F.filter(F.transform(F.slice(panels, 1, n), panel_text), lambda x: x != "")
    whole = F.array_join(texts, " | ")
    return F.when(F.length(whole) > length, F.concat(F.rtrim(F.substring(whole, 1, length - 3)), F.lit("..."))).otherwise(whole)


def bucket(panel: Column, name: str) -> Column:
    """The texts of one list (dialogue, narration, sfx) of an object-valued text_content; a caption counts as narration."""
    raw = panel["text_content"]
    own = F.coalesce(F.when(F.startswith(raw, F.lit("{")), F.from_json(F.get_json_object(raw, f"$.{name}"), "array<string>")), F.array().cast("array<string>"))
    own = F.filter(own, lambda x: x.isNotNull() & (F.trim(x) != ""))
    if name != "narration":
        return own
    cap = F.filter(F.array(_text(panel["caption"])), lambda x: x.isNotNull() & (x != ""))
    return F.concat(own, cap)


def total_length(texts: Column) -> Column:
    return F.aggregate(texts, F.lit(0), lambda acc, x: acc + F.length(x))


def category(dialogue: Column, narration: Column, sfx: Column) -> Column:
    """Which of the three kinds of text a panel has."""
    a, b, c = (F.size(x) > 0 for x in (dialogue, narration, sfx))
    return (
        F.when(a & b & c, "all_three").when(a & b, "dialogue_and_narration").when(a & c, "dialogue_and_sfx").when(b & c, "narration_and_sfx")
        .when(a, "dialogue_only").when(b, "narration_only").when(c, "sfx_only").otherwise("no_text")
    )


def sequence_text(page: DataFrame, strategy: str) -> Column:
    """One text for a page: all_text, overall_summary or summary_plot; an unknown strategy means all_text."""
    every = F.concat_ws(" ", "overall_summary", "summary_text", F.array_join(F.transform("panels", panel_text), " "))
    return {"overall_summary": F.coalesce("overall_summary", F.lit("")), "summary_plot": F.coalesce("summary_text", F.lit(""))}.get(strategy, F.trim(every))


def corpus(page: DataFrame) -> Column:
    """Lower-case summary, plot, panel texts and path: what label rules look for words in."""
    return F.lower(F.concat_ws(" \n ", "overall_summary", "summary_text", F.array_join(F.transform("panels", panel_text), " \n "), "image_path"))
