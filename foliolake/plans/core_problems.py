"""Queries and SQL of the general training-data problems: drifting schemas (1), heavy keys (6), nested records (7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolake.operators.nested_flatten import flat_table, flatten_pages, items_with_words, renamed_lists
from foliolake.operators.schema_drift import consistent_panels, distances, file_profiles, name_maps, reported_changes, schema_changes
from foliolake.operators.skew_agg import heavy_keys, key_counts, skewed_group_stats
from foliolake.runtime import materialize, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reported_changes(schema_changes(file_profiles(table(spark, sf_dir, "vlm_docs"))))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change with its script: the old path of a rename or move, the types before and after."""
    changes = schema_changes(file_profiles(table(spark, sf_dir, "vlm_docs")))
    return changes.withColumn("likeness", F.round("likeness", 4)).withColumn("cost", F.round("cost", 4))


def p1_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree edit distance between each file that changed and the one before it."""
    return distances(schema_changes(file_profiles(table(spark, sf_dir, "vlm_docs")))).withColumn("distance", F.round("distance", 4))


def p1_consistent_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "vlm_docs")
    profiles = materialize(file_profiles(docs), "p1_profiles")
    return consistent_panels(docs, name_maps(profiles, schema_changes(profiles)))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_keys(key_counts(table(spark, sf_dir, "page_vectors")))


def p6_series_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = skewed_group_stats(table(spark, sf_dir, "page_vectors"))
    return stats.withColumn("mean_vector", F.transform("mean_vector", lambda x: F.round(x, 5)))


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of a panel keep their role through the renames that problem 1 finds for a panel's own fields."""
    docs = table(spark, sf_dir, "vlm_docs")
    profiles = materialize(file_profiles(docs), "p7_profiles")
    changes = schema_changes(profiles).filter(F.size(F.split("field_path", r"\.")) <= 2)
    return flatten_pages(docs, materialize(renamed_lists(name_maps(profiles, changes)), "p7_renamed"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items_with_words(_flat(spark, sf_dir))


def p7_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_table(_flat(spark, sf_dir), "page")


def p7_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_table(_flat(spark, sf_dir), "panel")


def p7_text_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_table(_flat(spark, sf_dir), "text")


def p7_speaker_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_table(_flat(spark, sf_dir), "speakers")


_P6_UNITS = """
WITH marked AS (
  SELECT series, page_id, written_at,
         CASE WHEN len(page_embeddings) = 64
                   AND len(list_filter(page_embeddings, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
                   AND len(list_filter(page_embeddings, lambda x: x <> 0)) > 0 THEN page_embeddings END AS vec
  FROM page_vectors),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY series, page_id ORDER BY written_at DESC NULLS LAST, (vec IS NOT NULL) DESC, vec DESC) AS rn
  FROM marked)
"""

SQL = {
    "p6_found": """SELECT series FROM page_vectors WHERE series IS NOT NULL GROUP BY series
        HAVING count(*) >= 0.02 * (SELECT count(*) FROM page_vectors)""",
    "p6_series_stats": _P6_UNITS
    + """, dims AS (
  SELECT series, i, round(avg(vec[i]::DOUBLE), 5) AS m FROM (SELECT series, vec, unnest(range(1, 65)) AS i FROM ranked
  WHERE rn = 1 AND page_id IS NOT NULL AND vec IS NOT NULL) GROUP BY series, i),
means AS (SELECT series, list(m ORDER BY i) AS mean_vector FROM dims GROUP BY series),
counts AS (SELECT series, count(*) AS n_rows, count(DISTINCT page_id) AS n_pages, max(written_at) AS latest_written_at,
                  count(CASE WHEN rn = 1 AND page_id IS NOT NULL AND vec IS NOT NULL THEN 1 END) AS n_usable FROM ranked GROUP BY series)
SELECT c.series, n_rows, n_pages, latest_written_at, n_usable, mean_vector
FROM counts c LEFT JOIN means m ON c.series IS NOT DISTINCT FROM m.series""",
}

QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_report, p1_distances, p1_consistent_panels, p6_found, p6_series_stats, p7_found, p7_pages, p7_panels, p7_text_items, p7_speaker_lines)
}
