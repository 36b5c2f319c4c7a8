"""Writers. Every table is committed as a whole by Spark's protocol: a reader never sees half of one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str, *, gzip: bool = False) -> None:
    w = df.write.mode("overwrite").option("header", True)
    (w.option("compression", "gzip") if gzip else w).csv(path)


def parquet(df: DataFrame, path: str, *, by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite").option("compression", "snappy")
    (w.partitionBy(*by) if by else w).parquet(path)


def replace_parts(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrites only the partitions that ``df`` has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def json_lines(df: DataFrame, path: str) -> None:
    """One JSON document a line; fields that are null are left out."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def json_safe(df: DataFrame) -> DataFrame:
    """``df`` with what JSON has no way to write put otherwise: numbers that are NaN or infinite as null, bytes as text, or in base 64 where
    they are no UTF-8, times as ISO text. Nested fields stay as they are."""
    out = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("float", "double"):
            c = F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)
        elif kind == "binary":
            c = F.coalesce(F.try_validate_utf8(c.cast("string")), F.base64(c))
        elif kind in ("timestamp", "timestamp_ntz", "date"):
            c = F.date_format(c, "yyyy-MM-dd" if kind == "date" else "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        out.append(c.alias(f.name))
    return df.select(*out)


def tier_lists(df: DataFrame, path: str, *, tier: str, value: str) -> None:
    """Text files of paths, one folder for each tier."""
    df.select(F.col(tier).alias("tier"), F.col(value).cast("string").alias("value")).write.mode("overwrite").partitionBy("tier").text(path)


def one_file_per_key(df: DataFrame, root: str, *, key: str, text: str) -> None:
    """Export only: a file for each row, whole or not at all, through the file system of ``root`` (a path or an address that pyarrow knows:
    file, hdfs, s3, gs). On a cluster a local path is refused: each executor would write to its own disk. A null key or text writes an
    empty name part or an empty file."""
    if "://" not in root:
        if not df.sparkSession.sparkContext.master.startswith("local"):
            raise ValueError(f"{root}: give an address that all executors share")
        root = f"file://{root}"
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def write(part) -> None:  # noqa: ANN001
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        for r in part:
            at = "/".join([base.rstrip("/"), *[p for p in str(r["k"]).split("/") if p not in ("", ".", "..")]]) + ".json"
            system.create_dir(at.rpartition("/")[0], recursive=True)
            with system.open_output_stream(at + ".part") as f:
                f.write((r["t"] or "").encode())
            system.move(at + ".part", at)

    rows.foreachPartition(write)


def coco_documents(boxes: DataFrame) -> DataFrame:
    """(page, doc): one detector document for each page; box values whole numbers towards zero."""
    b = F.col("box")
    whole = F.array(*[b[k].cast("int") for k in "xywh"])
    ann = F.struct(F.col("box_id").alias("id"), F.col("label").alias("category"), whole.alias("bbox"), F.col("score").alias("score"))
    return boxes.groupBy("page").agg(F.to_json(F.struct(F.first("page").alias("image_id"), F.sort_array(F.collect_list(ann)).alias("annotations"))).alias("doc"))


def markdown(df: DataFrame, *, limit: int = 100) -> str:
    """A small result as a Markdown table; the report's own size is its bound."""
    rows = df.limit(limit).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])


def counted(df: DataFrame, name: str, **counts: Column):
    """(df, observation): named counts taken while ``df`` is written, without another pass."""
    from pyspark.sql import Observation

    o = Observation(name)
    return df.observe(o, *[c.alias(k) for k, c in counts.items()]), o
