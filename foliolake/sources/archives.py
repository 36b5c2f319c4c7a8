"""Comic archives as tables of pages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolake import schemas
from foliolake.operators.filters import is_junk_path


def pages_of_zip(content: bytes) -> Iterator[tuple[str, bytes]]:
    """(name, bytes) of the images of a zip container, in name order."""
    import io
    import zipfile

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for info in sorted(z.infolist(), key=lambda i: i.filename):
            if not info.is_dir() and info.filename.lower().endswith(schemas.IMAGE_SUFFIXES):
                yield info.filename, z.read(info)


def is_image(content: bytes | None) -> bool:
    """True for bytes that begin as one of the known image formats does."""
    c = content or b""
    return c[:3] == b"\xff\xd8\xff" or c[:8] == b"\x89PNG\r\n\x1a\n" or c[:6] in (b"GIF87a", b"GIF89a") or (c[:4] == b"RIFF" and c[8:12] == b"WEBP") or c[:2] == b"BM"


def archive_pages(spark: SparkSession, root: str) -> DataFrame:
    """One row for each page of the zip-like archives (cbz, zip, epub) under a folder, and one for each archive that can't be read
    (status corrupt) or whose format needs native libraries (cbr, pdf: status unsupported). Page status: ok or invalid image."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    raw = raw.filter(F.lower("path").rlike(r"\.(cbz|zip|epub|cbr|rar|pdf)$")).select("path", "content")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["archive", "member", "page_index", "size", "status", "content"]
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                if path.lower().endswith((".cbr", ".rar", ".pdf")):
                    yield pd.DataFrame([(path, None, None, None, "unsupported", None)], columns=columns)
                    continue
                try:
                    for n, (name, data) in enumerate(pages_of_zip(content)):
                        yield pd.DataFrame([(path, name, n, len(data), "ok" if is_image(data) else "invalid image", data)], columns=columns)
                except Exception as e:  # noqa: BLE001: any damage of a container is a row of the audit
                    yield pd.DataFrame([(path, None, None, None, f"corrupt: {type(e).__name__}", None)], columns=columns)

    return raw.mapInPandas(read, schemas.ARCHIVE_PAGES)


def _no_scheme(path: Column) -> Column:
    return F.regexp_replace(path, "^[a-z]+:/*", "/")


def build_manifest(pages: DataFrame, loose: DataFrame, *, root: str) -> tuple[DataFrame, DataFrame]:
    """(manifest, audit): pages of archives, then loose images (path) that no archive row has already, without junk paths; what can't be
    used goes to the audit (path, reason)."""
    inner = F.concat(F.regexp_replace("archive", r"\.[^./]+$", ""), F.lit("/"), F.regexp_replace("member", r"\.[^./]+$", ""))
    ok = pages.filter((F.col("status") == "ok") & ~is_junk_path(F.col("member"))).select(_no_scheme(inner).alias("full"), F.concat("archive", F.lit("!"), "member").alias("absolute_image_path"))
    rest = loose.filter(~is_junk_path(F.col("path"))).select(_no_scheme(F.regexp_replace("path", r"\.[^./]+$", "")).alias("full"), F.col("path").alias("absolute_image_path"))
    both = ok.unionByName(rest.join(ok.select("full"), "full", "left_anti"))
    cid = F.regexp_replace("full", "^" + root.rstrip("/") + "/", "")
    audit = pages.filter("status != 'ok'").select(F.coalesce(F.concat("archive", F.lit("!"), "member"), F.col("archive")).alias("path"), F.col("status").alias("reason"))
    return both.select(cid.alias("canonical_id"), "absolute_image_path"), audit
