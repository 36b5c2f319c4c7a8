"""Incremental tables: only new keys are worked on, upserts go to a new version, failures to a table of their own."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(current: DataFrame | None, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows by key: the first in the given order among both. ``incoming`` may repeat keys and rows already there; running it twice
    changes nothing. Columns that one side lacks are null."""
    both = incoming if current is None else current.unionByName(incoming, allowMissingColumns=True)
    return both.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def collisions(incoming: DataFrame, keys: list[str], normal: Column, order: list[Column]) -> DataFrame:
    """Rows whose normal key an earlier row of another key has: (keys..., normal_key), the first wins."""
    w = Window.partitionBy("normal_key").orderBy(*order)
    return incoming.withColumn("normal_key", normal).withColumn("_rn", F.row_number().over(w)).filter("_rn > 1").select(*keys, "normal_key")


class VersionConflict(RuntimeError):
    """Another writer logged a version after the one this writer read."""


class VersionedTable:
    """A table as a folder of versions and a log of one small file for each, named by its number: readers see the last logged version, a
    writer logs when its data stands. A version that was never logged is ignored. Of two writers that read the same version, the second
    to log gets :class:`VersionConflict`: a log file is created only where there is none, which the file system decides."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.seen: int | None = None

    def _files(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _last(self) -> tuple[int, str | None]:
        """(number, version) of the last log file that was written to its end."""
        files, at = self._files("_log")
        names = sorted((x.getPath().getName() for x in files.listStatus(at)), reverse=True) if files.exists(at) else []
        for name in names:
            lines = self.spark.read.text(f"{self.path}/_log/{name}").collect()  # one line
            if lines and lines[0]["value"].endswith(";"):
                return int(name), lines[0]["value"].split(" ")[0]
        return -1, None

    def version(self) -> str | None:
        return self._last()[1]

    def read(self) -> DataFrame | None:
        self.seen, v = self._last()
        return None if v is None else self.spark.read.parquet(f"{self.path}/{v}")

    def write(self, df: DataFrame) -> int:
        """Writes ``df`` as the version after the one read last by this object (the newest, if none was); returns its number of rows."""
        number = (self._last()[0] if self.seen is None else self.seen) + 1
        v = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{v}")
        n = self.spark.read.parquet(f"{self.path}/{v}").count()
        files, at = self._files(f"_log/{number:012d}")
        try:
            out = files.create(at, False)
        except Py4JJavaError as e:
            raise VersionConflict(f"{self.path}: version {number} is there already") from e
        out.write(f"{v} {n};".encode())
        out.close()
        self.seen = number
        return n

    def merge(self, incoming: DataFrame, keys: list[str], order: list[Column]) -> int:
        return self.write(upsert(self.read(), incoming, keys, order))


def append_new(spark: SparkSession, path: str, incoming: DataFrame, keys: list[str]) -> int:
    """Appends the rows whose key the table lacks; returns how many. A second run appends none."""
    try:
        done = spark.read.parquet(path).select(*keys)
        new = incoming.dropDuplicates(keys).join(done, keys, "left_anti")
    except AnalysisException:
        new = incoming.dropDuplicates(keys)
    from pyspark.sql import Observation

    seen = Observation()
    new.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]
