"""Readers: every source as a DataFrame with a fixed schema, all parsing on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliolake import schemas
from foliolake.functions import geometry as G
from foliolake.functions import keys as K


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Page catalogue; all columns stay text, so 001 is no number."""
    return spark.read.schema(schemas.MANIFEST).option("header", True).csv(path)


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header in a stated schema; empty fields are null, cells that don't fit their type as well."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def numeric_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns read as numbers, rows without all of them left out."""
    out = df
    for c in columns:
        out = out.withColumn(c, F.expr(f"try_cast(`{c}` as double)"))
    return out.dropna(subset=columns)


def coco(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """images, categories and boxes of detector output: boxes have their category's name (its number as text where unknown) and a score of 1
    where none is given. One document is one task to parse: write the result as Parquet before using it at scale."""
    doc = spark.read.schema(schemas.COCO).option("multiLine", True).json(path)
    cats = doc.select(F.explode("categories").alias("c")).select("c.*")
    images = doc.select(F.explode("images").alias("i")).select("i.*")
    ann = doc.select(F.explode("annotations").alias("a")).select("a.*")
    named = ann.join(cats.select(F.col("id").alias("category_id"), "name"), "category_id", "left")
    boxes = named.filter(F.size("bbox") == 4).select(
        F.col("image_id").alias("page"), F.col("id").alias("box_id"), F.coalesce("name", F.col("category_id").cast("string")).alias("label"), F.coalesce("score", F.lit(1.0)).alias("score"),
        G.box(F.col("bbox")[0], F.col("bbox")[1], F.col("bbox")[2], F.col("bbox")[3]).alias("box"),
    )
    return {"categories": cats, "images": images, "boxes": boxes}


def documents(spark: SparkSession, root: str, suffix: str = "json") -> DataFrame:
    """(key, path, doc): whole files under a folder, the key is the path below it without its suffix. Bytes are read as UTF-8, with or
    without a byte order mark, else as Windows-1252, else (bytes that it lacks) as Latin-1."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").load(root)
    valid = F.is_valid_utf8(F.col("content").cast("string"))

    def one(content: bytes | None) -> str | None:
        for encoding in ("cp1252", "latin-1"):
            try:
                return None if content is None else content.decode(encoding)
            except UnicodeDecodeError:
                continue

    @F.pandas_udf("string")
    def western(content):  # noqa: ANN001, ANN202
        return content.map(one)

    text = F.when(valid, F.col("content").cast("string")).otherwise(western(F.when(~valid, F.col("content"))))
    key = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), r"^.*?" + root.rstrip("/").rsplit("/", 1)[-1].replace(".", r"\.") + "/", "")
    return raw.select(F.regexp_replace(key, rf"\.{suffix}$", "").alias("key"), "path", F.regexp_replace(text, "^﻿", "").alias("doc"))


def path_list(spark: SparkSession, path: str, *, sample: int | None = None, seed: int = 42) -> DataFrame:
    """Distinct paths of a list file (one is kept for each normal form, the least), all or a stable sample."""
    rows = spark.read.text(path).select(F.trim("value").alias("path")).filter("path != ''")
    norm = F.lower(F.translate("path", "\\", "/"))
    own = rows.groupBy(norm.alias("norm")).agg(F.min("path").alias("path"))
    return own if sample is None else own.orderBy(F.xxhash64("norm", F.lit(seed)), "norm").limit(sample)


def image_index(spark: SparkSession, root: str) -> DataFrame:
    """(key, path, size) of the images under a folder; contents aren't read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"))
    is_image = K.any_of([F.lower("path").endswith(s) for s in schemas.IMAGE_SUFFIXES])
    return raw.filter(is_image).select(F.lower(F.element_at(K.path_parts(F.col("path")), -1)).alias("key"), "path", "size")


def objects_manifest(listing: DataFrame, *, limit: int | None = None) -> DataFrame:
    """Manifest rows of an object listing (bucket, object_key): images only, the id is the key without its suffix; the first ``limit`` keys."""
    images = listing.filter(K.any_of([F.lower("object_key").endswith(s) for s in schemas.IMAGE_SUFFIXES]))
    rows = images.select(F.regexp_replace("object_key", r"\.[^./]+$", "").alias("canonical_id"), F.concat(F.lit("s3://"), "bucket", F.lit("/"), "object_key").alias("absolute_image_path"))
    return rows if limit is None else rows.orderBy("canonical_id").limit(limit)


def file_counts(spark: SparkSession, root: str, *, glob: str = "*") -> DataFrame:
    """(folder, suffix, n, size) of all files below a folder, from the listing alone."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"))
    name = F.element_at(K.path_parts(F.col("path")), -1)
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    return raw.groupBy(folder.alias("folder"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("suffix")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))


def hash_names(spark: SparkSession, path: str) -> DataFrame:
    """(hash, book, chapter) of a CSV of book_chapter_hash, book_name, chapter_name; of repeated hashes the last book and chapter in order."""
    raw = spark.read.option("header", True).csv(path).select("book_chapter_hash", "book_name", "chapter_name")
    last = raw.groupBy(F.col("book_chapter_hash").alias("hash")).agg(F.max(F.struct("book_name", "chapter_name")).alias("x"))
    return last.select("hash", F.col("x.book_name").alias("book"), F.col("x.chapter_name").alias("chapter"))


def hash_page(path: Column) -> tuple[Column, Column]:
    """(hash, page) of a path that is hash/page.suffix, with any separator, or hash_page.suffix; null where there is neither."""
    parts = K.path_parts(path)
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    bits = F.split(stem, "_")
    in_folder = F.size(parts) >= 2
    return F.when(in_folder, F.element_at(parts, -2)).when(F.size(bits) >= 2, bits[0]), F.when(in_folder, stem).when(F.size(bits) >= 2, bits[1])


def activity_log(spark: SparkSession, path: str) -> DataFrame:
    log = csv_table(spark, path, schemas.ACTIVITY)
    return log.toDF("date", "slug", "usage", "requests", "prompt_tokens", "completion_tokens")


def model_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Flat rows of a catalogue document; prices as numbers, 0 where missing."""
    m = spark.read.schema(schemas.CATALOGUE).option("multiLine", True).json(path).select(F.explode("data").alias("m"))
    price = lambda c: F.coalesce(F.expr(f"try_cast(m.pricing.{c} as double)"), F.lit(0.0)).alias(f"price_{c}")
    return m.select(
        "m.id", "m.name", F.timestamp_seconds("m.created").alias("created"), "m.context_length", price("prompt"), price("completion"), price("image"),
        "m.architecture.modality", "m.architecture.tokenizer", "m.top_provider.max_completion_tokens", "m.top_provider.is_moderated",
    )


def error_log(spark: SparkSession, path: str) -> DataFrame:
    """(path, error) of log lines "... <path of an image>: <error>"."""
    rows = spark.read.text(path)
    where = r"((?:[A-Za-z]:)?[^:\s][^:]*\.(?:jpe?g|png|webp|gif)):?\s*(.*)$"
    return rows.select(F.regexp_extract("value", "(?i)" + where, 1).alias("path"), F.regexp_extract("value", "(?i)" + where, 2).alias("error")).filter("path != ''")


def vectors_npy(spark: SparkSession, root: str) -> DataFrame:
    """(store, row, vector) of two-dimensional .npy arrays under a folder."""
    import io

    import numpy as np
    import pandas as pd

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", True).load(root).select("path", "content")

    def read(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                for lo in range(0, len(a), 4096):
                    part = a[lo : lo + 4096].astype(np.float32)
                    yield pd.DataFrame({"store": path, "row": np.arange(lo, lo + len(part)), "vector": list(part)})

    return raw.mapInPandas(read, "store string, row long, vector array<float>")


def vectors_zarr(spark: SparkSession, root: str) -> DataFrame:
    """(row, vector) of a two-dimensional array in a Zarr store of version 2: a folder of ``.zarray`` and one file for each chunk, each of
    which is a task's work. Chunks may cut rows too, and be plain, zlib, gzip or zstd; other compressors and filters are refused. Rows of
    chunks that were never written are left out."""
    import json

    import numpy as np
    import pandas as pd
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
    with system.open_input_stream(f"{base}/.zarray") as f:
        meta = json.loads(f.read())
    (rows, width), (tall, wide) = meta["shape"], meta["chunks"]
    packed, apart = (meta.get("compressor") or {}).get("id"), meta.get("dimension_separator", ".")
    if packed not in (None, "zlib", "gzip", "zstd") or meta.get("filters"):
        raise ValueError(f"{root}: compressor {packed}, filters {meta.get('filters')}")
    kind, order = meta["dtype"], meta["order"]

    def unpacked(raw: bytes) -> bytes:
        if packed == "zstd":
            import zstandard

            return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        import zlib

        return raw if packed is None else zlib.decompress(raw, 47)  # of zlib or gzip

    def read(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                i, j = (int(x) for x in path.replace("\\", "/").rstrip("/").replace(apart, "/").split("/")[-2:])
                a = np.frombuffer(unpacked(content), kind).reshape((tall, wide), order=order)[: rows - i * tall, : width - j * wide].astype(np.float32)
                yield pd.DataFrame({"row": np.arange(i * tall, i * tall + len(a)), "at": j, "part": list(a)})

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "[0-9]*").load(root).select("path", "content")
    parts = raw.mapInPandas(read, "row long, at int, part array<float>")
    if wide >= width:
        return parts.select("row", F.col("part").alias("vector"))
    whole = parts.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("x"), F.count(F.lit(1)).alias("n"))  # the chunks of one row
    return whole.filter(F.col("n") == -(-width // wide)).select("row", F.flatten("x.part").alias("vector"))


def aligned_store(vectors: DataFrame, metadata: DataFrame, manifest: DataFrame, *, key: str = "canonical_id") -> DataFrame:
    """Vectors (row, vector) with the metadata (row, ``key``, ...) of their place and the manifest's row of their key. Where one side is longer
    its rest is left out, as are keys that the manifest lacks; the manifest's first row of a key by its columns in order counts. ``row`` stays."""
    rest = [c for c in manifest.columns if c != key and c not in metadata.columns and c not in ("row", "vector")]
    one = manifest.groupBy(key).agg(F.min(F.struct(*rest)).alias("m")).select(key, "m.*") if rest else manifest.select(key).distinct()
    return vectors.join(metadata, "row").join(one, key)


def latest(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row for each key: the one of the greatest version."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version)))).filter("_rn = 1").drop("_rn")
