"""Queries and SQL of the problems tagged llm."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolake.llm.bin_pack import fill_report, pack
from foliolake.llm.entity_match import match_pages
from foliolake.llm.group_split import SplitTables, inseparable_pairs, page_components
from foliolake.llm.markov_clusters import cluster_pairs, describe_clusters, similarity_clusters
from foliolake.llm.mixture import mix, reached_shares
from foliolake.llm.mojibake import damaged, fit, restore
from foliolake.llm.token_sizes import token_sizes
from foliolake.llm.varied_subset import choose_varied
from foliolake.runtime import materialize, shared_dir, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_matches(spark, sf_dir).select("image_id", "record_id").distinct()


def p2_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with the rule that found them and its confidence."""
    return match_pages(table(spark, sf_dir, "coco_images"), table(spark, sf_dir, "vlm_docs"))


def p3_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choose_varied(table(spark, sf_dir, "page_vectors"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_pairs(similarity_clusters(table(spark, sf_dir, "page_vectors")))


def p4_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe_clusters(similarity_clusters(table(spark, sf_dir, "page_vectors")))


def _p5_deliveries(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """All pages in two deliveries by day of ingestion, those of no day in the second; nothing is left out."""
    pages = table(spark, sf_dir, "page_vectors")
    span = pages.agg(F.min("ingested_at").alias("a"), F.max("ingested_at").alias("b")).first()
    if span["a"] is None:
        return [pages]
    early = F.coalesce(F.col("ingested_at") < F.lit(span["a"] + (span["b"] - span["a"]) / 2), F.lit(False))
    return [pages.filter(early), pages.filter(~early)]


def _p5_tables(spark: SparkSession) -> SplitTables:
    """The tables that ``foliolake.splits.path`` names, which later runs go on with; new ones in the shared folder where it is unset."""
    path = spark.conf.get("foliolake.splits.path", None) or f"{shared_dir(spark)}/splits-{uuid.uuid4().hex}"
    return SplitTables(spark, path)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _p5_tables(spark)
    for pages in _p5_deliveries(spark, sf_dir):
        components = tables.deliver(pages)
    return inseparable_pairs(components)


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its component and split, as one delivery."""
    tables, pages = _p5_tables(spark), table(spark, sf_dir, "page_vectors")
    members = materialize(page_components(pages, tables.deliver(pages)), "members")
    splits = tables.split(members.select("member", "component"), table(spark, sf_dir, "split_shares"))
    return members.select("page_id", "member").join(splits.select("member", "component", "split", "state"), "member").select("page_id", "component", "split", "state")


def p5_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in two deliveries, the second of which finds the first one's tables: members and records by delivery, split and state. What a
    merge would bring into one split from two is quarantined and has no split."""
    tables, seen, out = _p5_tables(spark), None, None
    for n, pages in enumerate(_p5_deliveries(spark, sf_dir), 1):
        seen = pages if seen is None else seen.unionByName(pages)
        members = materialize(page_components(seen, tables.deliver(pages)), "members").select("member", "component")
        splits = materialize(tables.split(members, table(spark, sf_dir, "split_shares")), "delivered")
        records = members.groupBy("member").agg(F.count(F.lit(1)).alias("n"))
        part = splits.join(records, "member", "left").groupBy("split", "state").agg(F.count(F.lit(1)).alias("members"), F.coalesce(F.sum("n"), F.lit(0)).alias("records"))
        part = part.select(F.lit(n).alias("delivery"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text is tokenized once; the sizes are read again by all that follows."""
    return materialize(token_sizes(table(spark, sf_dir, "documents")), "sizes")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_sizes(spark, sf_dir), table(spark, sf_dir, "pack_sizes"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "pack_sizes")
    return fill_report(pack(_sizes(spark, sf_dir), kinds), kinds)


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_sizes(spark, sf_dir), table(spark, sf_dir, "source_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, targets = _sizes(spark, sf_dir), table(spark, sf_dir, "source_targets")
    return reached_shares(mix(sizes, targets), sizes, targets)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return damaged(docs, fit(docs)).select("doc_id")


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affected documents with the chain found, its probability and the restored text."""
    docs = table(spark, sf_dir, "documents")
    return restore(docs, fit(docs)).withColumn("probability", F.round("probability", 4))


QUERIES = {f.__name__: f for f in (
        p2_found, p2_matches, p3_subset, p4_found, p4_clusters, p5_found, p5_splits, p5_deliveries, p8_containers, p8_fill, p9_mixture, p9_shares, p10_found, p10_restored,
    )}
SQL: dict[str, str] = {}
