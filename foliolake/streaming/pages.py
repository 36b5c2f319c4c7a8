"""Streams: new page documents become panels and page metrics, exactly once however often a batch is tried."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliolake.operators.nested_flatten import flat_table, flatten_pages


def page_metrics(docs: DataFrame) -> DataFrame:
    """(record_id, n_panels, n_texts, n_lines): what a document holds."""
    return _metrics(flatten_pages(docs))


def _metrics(flat: DataFrame) -> DataFrame:
    flat = flat.filter("kind != 'panel'").distinct()
    return flat.groupBy("record_id").agg(
        F.max(F.when(F.col("kind") == "page", F.col("panel_pos"))).alias("n_panels"), F.count(F.when((F.col("kind") == "text") & F.col("has_word"), 1)).alias("n_texts"),
        F.count(F.when((F.col("kind") == "speakers") & F.col("has_word"), 1)).alias("n_lines"),
    )


def refresh(spark: SparkSession, source: str, target: str, checkpoint: str, *, schema, files_per_batch: int = 100) -> StreamingQuery:
    """Works through all documents under ``source`` that no run has seen and stops: panels to ``target``/panels, metrics to
    ``target``/metrics, each batch to a folder of its number. A record_id is worked on once: the stream's state knows those of earlier
    batches, so no batch reads what others wrote, and one that is tried again after a failure writes its own folder anew."""
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source).dropDuplicates(["record_id"])

    def batch(df: DataFrame, number: int) -> None:
        flat = flatten_pages(df).persist()  # read by both
        flat_table(flat, "panel").write.mode("overwrite").parquet(f"{target}/panels/batch={number}")
        _metrics(flat).write.mode("overwrite").parquet(f"{target}/metrics/batch={number}")
        flat.unpersist()

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_events(events: DataFrame, *, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by event type and window of event time; rows later than the watermark are dropped when ``events`` is a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user: events no further apart than the gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
