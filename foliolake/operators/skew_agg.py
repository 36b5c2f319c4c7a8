"""Per-key results without a straggler when a few keys hold most rows: only mergeable states of keys are shuffled.

Spark's map-side hash aggregate keeps one state for each key and partition, spills it when memory is short, and merges the states
after the shuffle: a key with a third of all rows sends as many rows as there are map partitions. All sums here are over numbers of
fixed width, so the aggregate never falls back to sorting.

A unit (a page) counts once although it may have several rows. Units of one row, nearly all, go straight into their key's state. Which
units have several is told by a pass over hashes of (key, unit) alone; only those units' rows meet before they join the state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolake.runtime import materialize

#: Hashes of repeated units that are broadcast at most (8 bytes each); more are joined by shuffle.
MAX_BROADCAST = 2_000_000


def usable_vector(vector: Column, dim: int = 64) -> Column:
    """True for a vector of ``dim`` finite numbers that are not all zero; false for null."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def key_counts(df: DataFrame, *, key: str = "series") -> DataFrame:
    """(key, n_rows): one state for each key and partition is shuffled. Null is a key of its own."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))


def repeated_units(df: DataFrame, *, key: str, unit: str) -> DataFrame:
    """(h): hashes of the (key, unit) pairs that may have several rows; a pair of one row whose hash another pair shares is among them.
    Null units are left out."""
    h = df.filter(F.col(unit).isNotNull()).select(F.xxhash64(key, unit).alias("h"))
    return h.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")


def skewed_group_stats(
    df: DataFrame, *, key: str = "series", unit: str = "page_id", version: str = "written_at", vector: str = "page_embeddings", dim: int = 64, max_broadcast: int = MAX_BROADCAST
) -> DataFrame:
    """One row per ``key`` (null is a key of its own): ``n_rows``, ``n_pages``, ``latest_written_at``, ``n_usable``, ``mean_vector``.

    ``n_pages`` counts distinct non-null units. The mean is taken over one row for each unit of the key, its latest by ``version``
    (rows of equal version are equal in all that matters; among them a usable vector is preferred, then the greater one), if that
    row's vector is usable. A key without a usable vector has a null mean. Rows whose ``version`` is null come before all others.
    Units that are null count as rows and take no part in the mean. An empty table gives no rows; other columns are ignored.
    """
    hashes = materialize(repeated_units(df, key=key, unit=unit), "repeats")
    few = F.broadcast(hashes) if hashes.count() <= max_broadcast else hashes
    v = F.col(vector)
    slim = df.select(
        F.col(key).alias("key"), F.col(unit).alias("unit"), F.col(version).alias("version"), F.when(usable_vector(v, dim), v).alias("vec"), F.when(F.col(unit).isNotNull(), F.xxhash64(key, unit)).alias("h")
    )
    single = slim.join(few, "h", "left_anti").select("key", F.lit(1).cast("long").alias("n_rows"), F.col("version").alias("latest"), "unit", "vec")
    several = (
        slim.join(few, "h", "left_semi")
        .groupBy("key", "unit")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.max("version").alias("latest"),
            F.max(F.struct("version", F.col("vec").isNotNull().alias("ok"), "vec"))["vec"].alias("vec"),
        )
        .select("key", "n_rows", "latest", "unit", "vec")
    )
    use = F.col("unit").isNotNull() & F.col("vec").isNotNull()
    units = single.unionByName(several).withColumn("use", use)
    sums = [F.sum(F.when(F.col("use"), F.col("vec")[i].cast("double"))).alias(f"s{i}") for i in range(dim)]
    per_key = units.groupBy("key").agg(
        F.sum("n_rows").alias("n_rows"),
        F.count("unit").alias("n_pages"),
        F.max("latest").alias("latest_written_at"),
        F.count(F.when(F.col("use"), 1)).alias("n_usable"),
        *sums,
    )
    mean = F.when(F.col("n_usable") > 0, F.array(*[F.col(f"s{i}") / F.col("n_usable") for i in range(dim)]))
    return per_key.select(F.col("key").alias(key), "n_rows", "n_pages", "latest_written_at", "n_usable", mean.alias("mean_vector"))


def heavy_keys(counts: DataFrame, *, key: str = "series", share: float = 0.02) -> DataFrame:
    """Non-null keys that hold at least ``share`` of all rows counted in the result of :func:`key_counts` or :func:`skewed_group_stats`."""
    total = counts.agg(F.sum("n_rows").alias("all_rows"))
    # The null key is left out by its count, not by a filter that would be pushed below one side's aggregate: both sides read one exchange.
    own = F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.col("n_rows"))
    return counts.crossJoin(F.broadcast(total)).filter(own >= F.col("all_rows") * share).select(key)  # one row
