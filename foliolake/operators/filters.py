"""Predicates and filters over pages, texts, boxes and detections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_metadata(df: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Rows that equal (or, for a list, are among) the wanted values; names the table lacks are ignored."""
    conditions = [F.col(k).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(k) == v for k, v in wanted.items() if k in df.columns and v is not None]
    return df.filter(reduce(lambda a, b: a & b, conditions)) if conditions else df


def holds_text(text: Column, query: str, *, case: bool = False) -> Column:
    """Substring test on non-empty texts; the query's characters stand for themselves."""
    hit = F.contains(text, F.lit(query)) if case else F.contains(F.lower(text), F.lit(query.lower()))
    return F.coalesce((F.length(text) > 0) & hit, F.lit(False))


def keyword_search(df: DataFrame, query: str, k: int, *, text: str = "text", order: list[str]) -> DataFrame:
    """The first k rows, in the given order, whose text holds the query."""
    return df.filter(holds_text(F.col(text), query)).orderBy(*order).limit(k)


def id_search(df: DataFrame, query: str, *, ident: str) -> DataFrame:
    """Ids that hold the query, without case and with any path separators."""
    return df.filter(F.contains(F.translate(F.lower(F.col(ident)), "\\", "/"), F.lit(query.lower().replace("\\", "/"))))


def is_junk_path(path: Column) -> Column:
    return F.contains(path, F.lit("__MACOSX")) | F.contains(path, F.lit("/._"))


def junk_reason(path: Column) -> Column:
    """Each junk path once: archive metadata first, then hidden files."""
    return F.when(F.contains(path, F.lit("__MACOSX")), "__MACOSX").when(F.contains(path, F.lit("/._")), "._")


def disagree(a: Column, b: Column) -> Column:
    """True where the values differ or either is missing."""
    return a.isNull() | b.isNull() | (a != b)


def valid_box(box: Column) -> Column:
    """Four non-null numbers."""
    return F.coalesce((F.size(box) == 4) & F.forall(box, lambda x: x.isNotNull()), F.lit(False))


def confident(label: Column, score: Column, least: dict[str, float], *, strict: bool = False, default: float = 0.0) -> Column:
    """Score against the least of its label."""
    bar = F.lit(default)
    for k, v in least.items():
        bar = F.when(label == k, v).otherwise(bar)
    return score > bar if strict else score >= bar


def large_enough(width: Column, height: Column, page_area: Column, *, side: float = 32, share: float = 0.01) -> Column:
    return (width >= side) & (height >= side) & (width * height >= page_area * share)


def with_reasons(df: DataFrame, checks: list[tuple[str, Column]], ok: str = "added") -> DataFrame:
    """``reason``: the name of the first check that fails, else ``ok``."""
    out = F.lit(ok)
    for name, passed in reversed(checks):
        out = F.when(~F.coalesce(passed, F.lit(False)), name).otherwise(out)
    return df.withColumn("reason", out)
