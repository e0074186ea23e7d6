"""What is looked at: inclusion of files, routing of contents, severity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.functions import scalars, tables

MAX_FILE_BYTES = 20 * 1024 * 1024


def included(files: DataFrame, extensions: tuple[str, ...] = (), ignored: tuple[str, ...] = tables.IGNORED, max_bytes: int = MAX_FILE_BYTES, keep_images: bool = False) -> DataFrame:
    """Files worth a download. A size of 0 is unknown and passes. ``keep_images`` lets images through, for their metadata."""
    extension = F.regexp_replace(scalars.extension(F.col("key")), r"^\.", "")
    images = tables.EXTENSIONS["Image"]
    skipped = tuple(e for e in tables.SKIPPED if not (keep_images and e in images))
    keep = ~extension.isin(*skipped) & ~((F.col("size_bytes") != 0) & (F.col("size_bytes") > max_bytes))
    for fragment in ignored:
        keep = keep & ~F.col("key").contains(fragment)
    if extensions:
        keep = keep & extension.isin(*[e.lstrip(".") for e in extensions])
    return files.where(keep)


def routed(files: DataFrame, max_bytes: int = MAX_FILE_BYTES, deep_metadata: bool = True, extract_archives: bool = True) -> DataFrame:
    """files with ``route``: image, archive, skip_type, skip_size or text."""
    kind = F.col("file_type")
    route = F.when((kind == "Image") & F.lit(deep_metadata), "image").when((kind == "Archive") & F.lit(extract_archives), "archive")
    route = route.when(~scalars.is_text(kind), "skip_type").when((F.col("size_bytes") != 0) & (F.col("size_bytes") > max_bytes), "skip_size")
    return files.withColumn("route", route.otherwise("text"))


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    return findings.where(tables.rank(F.col("severity")) >= tables.SEVERITIES[severity][0])
