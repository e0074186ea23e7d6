"""Members of archives as rows. Unpacking has no native form: it is a batched Python function over binary rows."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import posixpath
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymark.functions import scalars

MAX_MEMBERS, MAX_MEMBER_BYTES, MAX_TOTAL_BYTES = 10_000, 50 * 1024 * 1024, 500 * 1024 * 1024
ZIPPED = (".zip", ".jar", ".war", ".ear", ".whl")
#: What reading an archive that is none may raise.
UNREADABLE = (ValueError, OSError, EOFError, zipfile.BadZipFile, tarfile.TarError, lzma.LZMAError)
TARRED = (".tar", ".tgz", ".tar.gz", ".tar.bz2", ".tar.xz", ".tbz2", ".txz")


def safe_path(raw: str) -> str | None:
    """The normalised relative path; None for an absolute one or one that leaves the archive."""
    parts = [p for p in raw.replace("\\", "/").split("/") if p not in ("", ".")]
    if raw.startswith(("/", "\\")) or ".." in parts or not parts:
        return None
    return "/".join(parts)


def _bounded(stream: io.BufferedIOBase) -> bytes | None:
    """All of a stream, or None if it holds more than a member may."""
    data = stream.read(MAX_MEMBER_BYTES + 1)
    return None if len(data) > MAX_MEMBER_BYTES else data


def _zip_members(data: bytes) -> Iterator[tuple[str, int, object]]:
    archive = zipfile.ZipFile(io.BytesIO(data))
    for info in archive.infolist():
        if not info.is_dir():
            yield info.filename, info.file_size, lambda info=info: archive.open(info)


def _tar_members(data: bytes) -> Iterator[tuple[str, int, object]]:
    archive = tarfile.open(fileobj=io.BytesIO(data), mode="r:*")
    for info in archive:
        if info.isfile():
            yield info.name, info.size, lambda info=info: archive.extractfile(info)


def members(name: str, data: bytes) -> Iterator[tuple[str, bytes]]:
    """(path, bytes) of an archive's regular files, within the caps. Members that cannot be read or are too large are passed over; an archive that cannot be read raises."""
    low = posixpath.basename(name).lower()
    if low.endswith(ZIPPED):
        found = _zip_members(data)
    elif low.endswith(TARRED):
        found = _tar_members(data)
    elif low.endswith((".gz", ".bz2", ".xz")):
        opener = {".gz": gzip.open, ".bz2": bz2.open, ".xz": lzma.open}[low[low.rindex(".") :]]
        found = iter([(posixpath.basename(name).rpartition(".")[0], 0, lambda: opener(io.BytesIO(data)))])
    else:
        raise ValueError(f"unsupported archive: {name}")
    total = 0
    for n, (raw, size, opened) in enumerate(found):
        if n >= MAX_MEMBERS:
            break
        path = safe_path(raw)
        if path is None or size > MAX_MEMBER_BYTES:
            continue
        try:
            with opened() as stream:
                content = _bounded(stream)
        except (OSError, EOFError, RuntimeError, NotImplementedError, zipfile.BadZipFile, tarfile.TarError, lzma.LZMAError):
            continue
        if content is None:
            continue
        total += len(content)
        if total > MAX_TOTAL_BYTES:
            break
        yield path, content


def unpacked(objects: DataFrame) -> DataFrame:
    """archive_path, member (bytes), error beside the columns of objects (file_url, content, ...): their members; an unreadable archive gives one row with its error.

    Members leave the worker a few at a time, so an archive's whole content is never held twice.
    """

    rest = [c for c in objects.columns if c != "content"]
    made = ["archive_path", "member", "error"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            urls, contents, others = frame["file_url"].tolist(), frame["content"].tolist(), frame[rest]
            for i, (url, data) in enumerate(zip(urls, contents, strict=True)):

                def of_archive(rows: list[tuple], i: int = i) -> pd.DataFrame:
                    same = others.iloc[[i] * len(rows)].reset_index(drop=True)
                    return pd.concat([same, pd.DataFrame(rows, columns=made)], axis=1)

                rows, size = [], 0
                try:
                    for path, content in members(url, bytes(data or b"")):
                        rows.append((path, content, None))
                        size += len(content)
                        if size > 1 << 22:
                            yield of_archive(rows)
                            rows, size = [], 0
                except UNREADABLE as e:
                    rows.append((None, None, f"{type(e).__name__}: {e}"))
                if rows:
                    yield of_archive(rows)

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in objects.select(*rest).schema.fields]
    return objects.mapInPandas(run, ", ".join([*kinds, "archive_path string", "member binary", "error string"]))


def fault(name: str, data: bytes) -> str | None:
    """Why an archive cannot be read, from its directory alone: no member is unpacked."""
    low = posixpath.basename(name).lower()
    try:
        if low.endswith(ZIPPED):
            zipfile.ZipFile(io.BytesIO(data)).infolist()
        elif low.endswith(TARRED):
            for _ in tarfile.open(fileobj=io.BytesIO(data), mode="r:*"):
                pass
        elif not low.endswith((".gz", ".bz2", ".xz")):
            raise ValueError(f"unsupported archive: {name}")
    except UNREADABLE as e:
        return f"{type(e).__name__}: {e}"
    return None


def unreadable(objects: DataFrame) -> DataFrame:
    """The columns of objects (file_url, content, ...) but the content, and ``error``, for archives that cannot be read."""
    rest = [c for c in objects.columns if c != "content"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            error = [fault(u, bytes(d or b"")) for u, d in zip(frame["file_url"], frame["content"], strict=True)]
            yield frame[rest].assign(error=error)

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in objects.select(*rest).schema.fields]
    return objects.mapInPandas(run, ", ".join([*kinds, "error string"])).where("error IS NOT NULL")


def texts(unpacked_rows: DataFrame) -> DataFrame:
    """Members that are text by type and have few NUL bytes, as contents (file_url ``archive!/member``), with the archives' other columns."""
    rest = [c for c in unpacked_rows.columns if c not in ("file_url", "file_type", "archive_path", "member", "error")]
    kind = scalars.file_type(F.col("archive_path"))
    raw = F.hex("member")
    nul = F.length(raw) / 2 - F.length(F.regexp_replace(raw, "(?:00)|(..)", "$1")) / 2
    rows = unpacked_rows.where(F.col("member").isNotNull()).withColumn("file_type", kind).where(scalars.is_text(F.col("file_type")) & ~F.col("file_type").isin("Archive"))
    rows = rows.where(nul < 0.05 * F.greatest(F.octet_length("member"), F.lit(1)))
    url = F.concat("file_url", F.lit("!/"), F.col("archive_path"))
    return rows.select(url.alias("file_url"), "file_type", F.make_valid_utf8(F.col("member").cast("string")).alias("content"), "archive_path", F.lit(True).alias("from_archive"), *rest)


def is_archive(url: Column) -> Column:
    return scalars.file_type(url).isin("Archive")
