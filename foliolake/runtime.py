"""Session helpers shared by all operators: table access and lineage cuts that survive a lost executor."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the data set in ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one where that is unset and all work is on one machine
    (tests). On a cluster there is none to fall back on: an error says so."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="foliolake-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Tables written by :func:`materialize` that stand in the shared folder.
_written: dict[str, SparkSession] = {}


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it back.

    It cuts the lineage, keeps columnar statistics for the plans that follow and can be read again after any executor is lost. Results
    are read lazily, so the table stays until :func:`clear_materialized`, at the latest until this process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(clear_materialized)
    _written[path] = spark
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_materialized(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialize` that nothing reads any more."""
    for path in {os.path.dirname(x) for x in df.inputFiles()}:
        _delete(df.sparkSession, path)
        for own in [x for x in _written if x.rpartition("/")[2] == path.rpartition("/")[2]]:
            del _written[own]


def clear_materialized() -> None:
    """Delete all tables of this process that :func:`materialize` made: results that weren't read yet are lost with them. Tables of a
    session that has ended stay."""
    for path, spark in list(_written.items()):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001: the session is gone
            pass
        del _written[path]


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least half as many partitions as there are cores, for work in Python that a few small files would leave to a few
    cores. A table of more partitions stays as it is and nothing is shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df
