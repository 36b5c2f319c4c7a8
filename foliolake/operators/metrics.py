"""Classification and segment metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    """(label, pred, n, share): counts and their share of the label's rows; rows with either missing are left out."""
    c = df.filter(F.col(label).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("label")))


def class_scores(confused: DataFrame) -> DataFrame:
    """(cls, support, predicted, hits, precision, recall, f1): 0 where a ratio has no denominator."""
    lab = confused.groupBy(F.col("label").alias("cls")).agg(F.sum("n").alias("support"))
    pre = confused.groupBy(F.col("pred").alias("cls")).agg(F.sum("n").alias("predicted"))
    hit = confused.filter("label = pred").select(F.col("label").alias("cls"), F.col("n").alias("hits"))
    j = lab.join(pre, "cls", "full_outer").join(hit, "cls", "left").na.fill(0, ["support", "predicted", "hits"])
    p = F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(0.0)
    j = j.withColumn("precision", p).withColumn("recall", r)
    return j.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def overall_scores(scores: DataFrame, *, declared: int | None = None) -> DataFrame:
    """accuracy, macro F1 over the classes that occur and over ``declared`` classes, weighted F1: one row."""
    a = scores.agg(F.sum("hits").alias("h"), F.sum("support").alias("s"), F.sum("f1").alias("f"), F.count(F.lit(1)).alias("k"), F.sum(F.col("f1") * F.col("support")).alias("w"))
    return a.select(
        (F.col("h") / F.col("s")).alias("accuracy"), (F.col("f") / F.col("k")).alias("macro_f1"), (F.col("f") / F.lit(declared if declared else 1)).alias("macro_f1_declared"),
        (F.col("w") / F.col("s")).alias("weighted_f1"),
    )


def segment_scores(true: DataFrame, found: DataFrame, *, book: list[str], label: str = "label") -> DataFrame:
    """Panoptic quality of page segments (book..., label, first, last), one row: matches are segments of one label with an overlap of more
    than half their union; sq is their mean overlap, rq = matches / (matches + half the rest), pq = sq * rq."""
    t, f = true.select(*book, label, F.col("first").alias("t1"), F.col("last").alias("t2")), found.select(*book, label, F.col("first").alias("f1"), F.col("last").alias("f2"))
    inter = F.greatest(F.lit(0), F.least("t2", "f2") - F.greatest("t1", "f1") + 1)
    iou = inter / ((F.col("t2") - F.col("t1") + 1) + (F.col("f2") - F.col("f1") + 1) - inter)
    m = t.join(f, [*book, label]).withColumn("iou", iou).filter("iou > 0.5").agg(F.count(F.lit(1)).alias("tp"), F.sum("iou").alias("s"))
    n = true.agg(F.count(F.lit(1)).alias("nt")).crossJoin(found.agg(F.count(F.lit(1)).alias("nf"))).crossJoin(m)  # one row each
    tp, s = F.col("tp"), F.coalesce("s", F.lit(0.0))
    sq = F.when(tp > 0, s / tp).otherwise(0.0)
    rq = F.when(F.col("nt") + F.col("nf") > 0, 2 * tp / (F.col("nt") + F.col("nf"))).otherwise(0.0)
    return n.select("nt", "nf", "tp", sq.alias("sq"), rq.alias("rq"), (sq * rq).alias("pq"))


def boundary_distance(true: DataFrame, found: DataFrame, *, book: list[str]) -> DataFrame:
    """Mean over books of the mean distance from each true segment start to the nearest found start; a book without found starts counts
    its length. ``true``, ``found``: book..., first, last."""
    t = true.select(*book, "first", F.max("last").over(Window.partitionBy(*book)).alias("length"))
    f = found.select(*book, F.col("first").alias("g"))
    d = t.join(f, book, "left").groupBy(*book, "first", "length").agg(F.min(F.abs(F.col("first") - F.col("g"))).alias("d"))
    per = d.groupBy(*book).agg(F.avg(F.coalesce("d", "length")).alias("d"))
    return per.agg(F.avg("d").alias("mndd"), F.count(F.lit(1)).alias("books"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): n_all / (classes * n)."""
    c = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    a = c.agg(F.sum("n").alias("a"), F.count(F.lit(1)).alias("k"))
    return c.crossJoin(F.broadcast(a)).select(label, "n", (F.col("a") / (F.col("k") * F.col("n"))).alias("weight"))  # one row
