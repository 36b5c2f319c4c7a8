"""Agreement of detector and analysis panel counts: scores, tiers, summaries. The directions of ratios stand in their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or missing."""
    return F.coalesce(F.when(b > 0, a / b), F.lit(0.0))


def score_by_flags(found: Column, analysed: Column, vlm_per_rcnn: Column, text_cover: Column, density: Column) -> Column:
    """0..5: one for each of detector panels, an analysis, a ratio of 0.7 to 1.3, texts on 0.3 of the panels, one text a panel."""
    flags = [found > 0, analysed, (found > 0) & vlm_per_rcnn.between(0.7, 1.3), (found > 0) & (text_cover >= 0.3), density >= 1.0]
    return sum((F.coalesce(f, F.lit(False)).cast("int") for f in flags), F.lit(0))


def score_by_steps(rcnn_per_vlm: Column, text_cover: Column, vlm_panels: Column, *, least_cover: float = 0.8) -> Column:
    """0..4 in halves: ratio within 0.1 (2) or 0.2 (1) of 1, cover of at least the least (1) or 0.2 less (0.5), 1-15 panels (1) or 1-20 (0.5)."""
    a = F.when(rcnn_per_vlm.between(0.9, 1.1), 2.0).when(rcnn_per_vlm.between(0.8, 1.2), 1.0).otherwise(0.0)
    b = F.when(text_cover >= least_cover, 1.0).when(text_cover >= max(0.0, least_cover - 0.2), 0.5).otherwise(0.0)
    c = F.when(vlm_panels.between(1, 15), 1.0).when(vlm_panels.between(1, 20), 0.5).otherwise(0.0)
    return a + b + c


def tiers(score: Column, r: Column) -> dict[str, Column]:
    """Membership of three schemes: flags (whole scores; near includes perfect), steps (near excludes perfect; a score of 3.5 is in no
    tier) and bands (by score alone)."""
    return {
        "flags_high": score >= 4, "flags_medium": score == 3, "flags_low": score <= 2, "flags_near": r.between(0.9, 1.1),
        "steps_high": score >= 4, "steps_medium": score == 3, "steps_low": score < 3, "steps_near": r.between(0.9, 1.1) & (r != 1.0), "perfect": r == 1.0,
        "bands_near": score >= 3.5, "bands_high": score >= 2.5, "bands_medium": (score >= 1.5) & (score < 2.5), "bands_low": score < 1.5,
    }


def difference_summary(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: pairs, mean difference, shares exact, within one, above and below, over rows that have both counts."""
    d = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("d", F.col(a) - F.col(b))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return d.agg(
        F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_diff"), share(F.col("d") == 0).alias("exact"), share(F.abs("d") <= 1).alias("within_one"),
        share(F.col("d") > 0).alias("above"), share(F.col("d") < 0).alias("below"),
    )


def difference_histogram(df: DataFrame, a: str, b: str, *, top: int = 15) -> DataFrame:
    """The most frequent differences; of equally frequent ones the smaller first."""
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy((F.col(a) - F.col(b)).alias("diff")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "diff").limit(top)


def zero_filled(df: DataFrame, score: str, values: range) -> DataFrame:
    """(score, n) for every value, 0 where no row has it."""
    every = df.sparkSession.range(values.start, values.stop).select(F.col("id").cast("int").alias(score))
    return every.join(df.groupBy(score).agg(F.count(F.lit(1)).alias("n")), score, "left").na.fill(0, ["n"])
