"""Small scalar functions: maps of literals, dates, confidences, masks, hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Page classes in the order of their numbers.
PAGE_CLASSES = ("advertisement", "cover", "story", "textstory", "first-page", "credits", "art", "text", "back_cover")


def literal_map(value: Column, pairs: dict) -> Column:
    """The value a key stands for; null for keys the map lacks."""
    out = F.lit(None)
    for k, v in pairs.items():
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def class_number(name: Column) -> Column:
    return literal_map(name, {c: i for i, c in enumerate(PAGE_CLASSES)})


def class_name(number: Column) -> Column:
    """Null for -1 and other numbers without a class."""
    return literal_map(number, dict(enumerate(PAGE_CLASSES)))


#: Page classes and the categories of a page list.
CATEGORIES = {"cover": "covers", "credits": "credits", "story": "stories", "advertisement": "advertisements", "art": "art", "text": "text", "back_cover": "back_covers"}


def category_of(page_class: Column) -> Column:
    """Null for classes without a category."""
    return literal_map(page_class, CATEGORIES)


def on_date(day: Column, prefix: str) -> Column:
    """True where an ISO date or time begins with the prefix (2025, 2025-12, 2025-12-31)."""
    return F.startswith(day.cast("string"), F.lit(prefix))


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def ocr_confidence(percent: Column) -> Column:
    """0..1 of a percentage; negative values mean unknown and give 0."""
    return F.greatest(percent / 100, F.lit(0.0))


def joined_text(texts: Column) -> Column:
    """The texts that aren't blank, joined by blanks."""
    return F.array_join(F.filter(texts, lambda t: t.isNotNull() & (F.trim(t) != "")), " ")


def modality_mask(has_image: Column, text: Column, has_box: Column) -> Column:
    one = lambda c: F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)
    return F.array(one(has_image), one(F.trim(text) != ""), one(has_box))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def ceil_to(x: Column, step: int) -> Column:
    return F.ceil(x / step) * step


def permutation_edges(df: DataFrame, group: list[str], position: str, item: str) -> DataFrame:
    """(group..., src, dst): each item with the one after it."""
    from pyspark.sql import Window

    nxt = F.lead(item).over(Window.partitionBy(*group).orderBy(position))
    return df.select(*group, F.col(item).alias("src"), nxt.alias("dst")).filter("dst is not null")


def detector_id(folder: Column, file_name: Column) -> Column:
    """folder_file, blanks kept, as the detector names pages."""
    return F.concat(folder, F.lit("_"), F.regexp_replace(file_name, r"\.[^.]+$", ""))


def document_name(key: Column) -> Column:
    """File name of a key's document: separators and colons to "_"."""
    return F.concat(F.translate(key, "/\\:", "___"), F.lit(".json"))


def probe(doc: Column, paths: tuple[str, ...] = ("$.panels", "$.result.panels", "$.page.panels", "$.data.panels", "$[0].panels")) -> Column:
    """The first of several places a JSON document may keep its panels in, as JSON text."""
    return F.coalesce(*[F.get_json_object(doc, p) for p in paths])


def speech_kind(kind: Column) -> Column:
    """Kinds of speech by part of their name, narration first."""
    k = F.lower(kind)
    return (
        F.when(k.contains("narr"), "narration").when(k.contains("cap"), "caption").when(k.contains("sfx") | k.contains("sound"), "sfx").when(k.contains("ocr"), "ocr")
        .otherwise("dialogue")
    )
