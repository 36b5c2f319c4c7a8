"""Page labels by weighted rules: every rule adds its weight to a label where its condition holds, the best label wins.

Rules are data: a label, a condition over the page's columns, a weight. Words are looked up in a lower-case text column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    label: str
    weight: float
    words: tuple[str, ...] = ()
    where: str | None = None

    def holds(self, text: Column) -> Column:
        hit = F.lit(True)
        if self.words:
            hit = F.lit(False)
            for w in self.words:
                hit = hit | F.contains(text, F.lit(w))
        if self.where:
            hit = hit & F.coalesce(F.expr(self.where), F.lit(False))
        return F.coalesce(hit, F.lit(False))


#: Words that speak for a kind of page.
COVER_WORDS = ("cover", "variant cover", "barcode", "logo")
SPLASH_WORDS = ("splash page", "full-page", "full page")
LETTER_WORDS = ("letters page", "letter column", "fan mail", "mailbag", "letters to the editor")
RECAP_WORDS = ("previously", "recap", "last issue", "summary")
PREVIEW_WORDS = ("preview", "first look", "sample pages")

#: Default rules over pos_share, panels, text_coverage.
PAGE_RULES = (
    Rule("cover", 2.0, where="pos_share <= 0.03"),
    Rule("cover", 2.0, words=COVER_WORDS),
    Rule("cover", 0.5, where="panels <= 1"),
    Rule("back_cover", 2.0, where="pos_share >= 0.97"),
    Rule("splash", 1.8, where="pos_share between 0.05 and 0.95 and panels <= 1"),
    Rule("splash", 0.7, words=SPLASH_WORDS),
    Rule("letters", 3.0, words=LETTER_WORDS),
    Rule("recap", 2.0, words=RECAP_WORDS, where="pos_share <= 0.15"),
    Rule("preview", 2.5, words=PREVIEW_WORDS, where="panels >= 3"),
    Rule("interior", 1.5, where="pos_share between 0.05 and 0.95 and panels >= 2"),
    Rule("interior", 0.7, where="text_coverage >= 0.4"),
)


def score_labels(df: DataFrame, rules: tuple[Rule, ...] = PAGE_RULES, *, text: str = "corpus") -> DataFrame:
    """``page_type`` and ``confidence``: the label of the greatest sum of weights; of equals the one named first in the rules. A null text
    holds no word; a condition that is null doesn't hold."""
    labels = list(dict.fromkeys(r.label for r in rules))
    body = F.coalesce(F.col(text), F.lit(""))
    sums = [sum((F.when(r.holds(body), r.weight).otherwise(0.0) for r in rules if r.label == lab), F.lit(0.0)) for lab in labels]
    best = F.array_max(F.array(*[F.struct(F.round(s, 6).alias("s"), F.lit(-i).alias("i"), F.lit(lab).alias("l")) for i, (lab, s) in enumerate(zip(labels, sums))]))
    return df.withColumn("_best", best).withColumn("page_type", F.col("_best.l")).withColumn("confidence", F.col("_best.s")).drop("_best")
