"""Hooks for models and engines: a function over pages runs in Arrow batches, its failures are rows, retries are bounded.

An engine gets one page's inputs and returns its fields, or raises. Which engine runs is a parameter; stubs stand in for tests and
for places without models.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Engine = Callable[[dict], dict]


class Retryable(RuntimeError):
    """A failure worth another try; ``status`` as in HTTP."""

    def __init__(self, message: str, status: int = 503) -> None:
        super().__init__(message)
        self.status = status


def wait_seconds(status: int, attempt: int, spread: float) -> float | None:
    """The waits of 15 and 10, 5 and 5 seconds. Seconds to wait before trying again after the ``attempt``-th failure (from 0); None for failures that stay. ``spread``: 0..1."""
    if status == 429:
        return 15.0 * (attempt + 1) + 10.0 * spread
    if status >= 500:
        return 5.0 * (attempt + 1) + 5.0 * spread
    return None


def run_engine(
    pages: DataFrame, engine: Engine, schema: str, *, key: str = "page_id", attempts: int = 3, sleep: Callable[[float], None] = time.sleep, seed: int = 0
) -> DataFrame:
    """Key, the engine's fields (``schema``), ``status`` (ok, failed) and ``error`` for every page; a page never fails its batch."""
    fields = [part.strip().split(" ")[0] for part in schema.split(", ")]
    kind = pages.schema[key].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = random.Random(seed)
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                out, error = None, None
                for attempt in range(attempts):
                    try:
                        out = engine(row)
                        error = None
                        break
                    except Retryable as e:
                        error = f"{e.status}: {e}"
                        wait = wait_seconds(e.status, attempt, rng.random())
                        if wait is None or attempt + 1 == attempts:
                            break
                        sleep(wait)
                    except Exception as e:  # noqa: BLE001: any failure of an engine is a row
                        error = f"{type(e).__name__}: {e}"
                        break
                rows.append((row[key], *[(out or {}).get(f) for f in fields], "failed" if error else "ok", error))
            yield pd.DataFrame(rows, columns=[key, *fields, "status", "error"])

    return pages.mapInPandas(work, f"{key} {kind}, {schema}, status string, error string")


def escalate(pages: DataFrame, engines: list[Engine], schema: str, *, key: str = "page_id") -> DataFrame:
    """Each engine gets what the ones before it failed on: (as :func:`run_engine`, ``step`` from 0)."""
    from foliolake.runtime import materialize

    todo, done = pages, None
    for step, engine in enumerate(engines):
        res = materialize(run_engine(todo, engine, schema, key=key, attempts=1).withColumn("step", F.lit(step)), "engine")
        keep = res if step + 1 == len(engines) else res.filter("status = 'ok'")
        done = keep if done is None else done.unionByName(keep)
        todo = todo.join(res.filter("status != 'ok'").select(key), key, "left_semi")
    return done


def retry_failed(pages: DataFrame, dead: DataFrame, engine: Engine, schema: str, *, key: str = "page_id", most: int = 3) -> tuple[DataFrame, DataFrame]:
    """(done, dead): the pages of the dead-letter table ``dead`` (key, attempts, error) run again, but for those tried ``most`` times. What
    succeeds leaves the table; what fails stays there with its new error and one attempt more; keys without a page stay as they are."""
    from foliolake.runtime import materialize

    due = dead.filter(F.col("attempts") < most)
    res = materialize(run_engine(pages.join(due.select(key), key, "left_semi"), engine, schema, key=key, attempts=1), "retried")
    tried = res.select(key, "status", F.col("error").alias("_new"))
    left = dead.join(tried, key, "left").filter("status is null or status != 'ok'")
    again = F.col("status").isNotNull()
    return res.filter("status = 'ok'").drop("status", "error"), left.select(
        key, F.when(again, F.col("attempts") + 1).otherwise(F.col("attempts")).alias("attempts"), F.when(again, F.col("_new")).otherwise(F.col("error")).alias("error")
    )


def classify(df: DataFrame, scores: Callable, labels: list[str], *, ident: str = "page_id", vector: str = "page_embeddings", dim: int = 64) -> DataFrame:
    """(ident, prediction, label): the place and name of the greatest score, the first of equals, of every vector of ``dim`` finite numbers;
    other rows have no prediction. ``scores``: from a matrix of vectors to a matrix of one column for each label; it runs on Arrow batches.
    The table stands beside the vectors and is joined to them at read."""
    kind = df.schema[ident].dataType.simpleString()

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names = pa.array(labels, pa.string())
        for batch in batches:
            flat = batch.column(vector).flatten().to_numpy(zero_copy_only=False)
            best = np.argmax(scores(flat.reshape(-1, dim).astype(np.float64)), axis=1).astype(np.int32) if batch.num_rows else np.zeros(0, np.int32)
            yield pa.record_batch([batch.column(ident), pa.array(best), names.take(pa.array(best))], names=[ident, "prediction", "label"])

    fine = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.filter((F.size(vector) == dim) & fine).select(ident, vector).mapInArrow(work, f"{ident} {kind}, prediction int, label string")


def hashed_words(text: str | None, dim: int = 64) -> list[float]:
    """Stub encoder: a unit vector of hashed word counts; zeros for a text without words."""
    import hashlib
    import math

    v = [0.0] * dim
    for w in (text or "").lower().split():
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
        v[h % dim] += 1.0 if h >> 63 else -1.0
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else v


def encode(df: DataFrame, *, ident: str, text: str, encoder: Callable[[str | None], list[float]] = hashed_words) -> DataFrame:
    """(ident, embedding) of every text."""
    kind = df.schema[ident].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({ident: pdf[ident], "embedding": [encoder(t) for t in pdf[text]]})

    return df.select(ident, text).mapInPandas(work, f"{ident} {kind}, embedding array<double>")


def task_samples(pages: DataFrame, *, seed: int = 42) -> DataFrame:
    """(page_id, task, subject): seeded training tasks of each page (``page_id``, ``panels``: count) it has panels enough for: reading_order
    from 2, panel_picking from 2 (which panel is left out), closure from 4 (which inner panel is hidden)."""
    drawn = lambda name: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{name}:"), F.col("page_id").cast("string"))), 1, 8), 16, 10).cast("long")
    h = lambda name: F.try_mod(drawn(name), F.col("panels")).cast("int")
    inner = (F.try_mod(drawn("closure"), F.col("panels") - 2) + 1).cast("int")
    t = F.array(
        F.when(F.col("panels") >= 2, F.struct(F.lit("reading_order").alias("task"), F.lit(None).cast("int").alias("subject"))),
        F.when(F.col("panels") >= 2, F.struct(F.lit("panel_picking").alias("task"), h("panel_picking").alias("subject"))),
        F.when(F.col("panels") >= 4, F.struct(F.lit("closure").alias("task"), inner.alias("subject"))),
    )
    return pages.select("page_id", F.explode(F.filter(t, lambda x: x.isNotNull())).alias("t")).select("page_id", "t.task", "t.subject")


def shuffled_stories(pages: DataFrame, book: list[str], *, label: str = "page_type", story: str = "story", seed: int = 42) -> DataFrame:
    """``new_position`` within each book: story pages change places among themselves by seeded hash, all others stay. A book whose name
    is null in part is a book like any other; pages of equal position go by page_id; a page without a label stays."""
    from pyspark.sql import Window

    w = Window.partitionBy(*book)
    stories = pages.filter(F.col(label) == story)
    order = F.row_number().over(w.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("page_id").cast("string"))), "page_id"))
    slots = stories.select(*[F.col(c).alias(f"_{c}") for c in book], F.col("position").alias("new_position"), F.row_number().over(w.orderBy("position", "page_id")).alias("_place"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in book] + [F.col("_order") == F.col("_place")]
    moved = stories.withColumn("_order", order).join(slots, same).select(*pages.columns, "new_position")
    still = pages.filter((F.col(label) != story) | F.col(label).isNull()).withColumn("new_position", F.col("position"))
    return still.unionByName(moved)
