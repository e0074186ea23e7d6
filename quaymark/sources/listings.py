"""Object listings and link pages, from bodies that are at hand as rows, and crawls over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.functions import scalars, tables
from quaymark.sources.kept import checkpointed

S3_LISTING = "Name string, IsTruncated string, NextContinuationToken string, NextMarker string, Contents array<struct<Key:string,Size:string,LastModified:string,ETag:string>>, CommonPrefixes array<struct<Prefix:string>>"
AZURE_LISTING = "_ServiceEndpoint string, ContainerName string, NextMarker string, Blobs struct<Blob:array<struct<Name:string,Properties:struct<`Content-Length`:string,`Last-Modified`:string>>>>"
LINK = r"(?i)<a[^>]+href=[\"']([^\"'?#][^\"']*)[\"']"


def _xml(body: Column, kind: str) -> Column:
    return F.from_xml(body, kind, {"mode": "PERMISSIVE"})


def _size(text: Column) -> Column:
    return F.when(text.rlike(r"^[0-9]{1,18}$"), text.cast("long")).otherwise(F.lit(0).cast("long"))


def _files(rows: DataFrame, key: Column, size: Column, modified: Column, etag: Column) -> DataFrame:
    url = scalars.key_to_url(F.col("base_url"), key)
    out = rows.select("base_url", url.alias("url"), key.alias("key"), size.alias("size_bytes"), F.coalesce(modified, F.lit("")).alias("last_modified"), F.coalesce(etag, F.lit("")).alias("etag"), F.col("pos").cast("long").alias("ordinal"))
    return out.where((F.coalesce(F.col("key"), F.lit("")) != "") & ~F.col("key").endswith("/")).withColumn("file_type", scalars.file_type(F.col("url")))


def s3_files(bodies: DataFrame) -> DataFrame:
    """Files of S3 or GCS listings, from base_url and body; directory markers are left out, malformed bodies have none."""
    rows = bodies.withColumn("x", _xml(F.col("body"), S3_LISTING)).select("base_url", F.posexplode("x.Contents").alias("pos", "c"))
    return _files(rows, F.col("c.Key"), _size(F.col("c.Size")), F.col("c.LastModified"), F.replace(F.col("c.ETag"), F.lit('"'), F.lit("")))


def s3_pages(bodies: DataFrame) -> DataFrame:
    """base_url, truncated, token, prefixes: how a listing goes on. The token is the continuation token, or else the marker."""
    x = bodies.withColumn("x", _xml(F.col("body"), S3_LISTING))
    prefixes = F.coalesce(F.filter(F.transform("x.CommonPrefixes", lambda p: p["Prefix"]), lambda p: p != ""), F.array().cast("array<string>"))
    return x.select("base_url", F.coalesce(F.lower("x.IsTruncated") == "true", F.lit(False)).alias("truncated"), F.coalesce("x.NextContinuationToken", "x.NextMarker").alias("token"), prefixes.alias("prefixes"))


def azure_files(bodies: DataFrame) -> DataFrame:
    rows = bodies.withColumn("x", _xml(F.col("body"), AZURE_LISTING)).select("base_url", F.posexplode("x.Blobs.Blob").alias("pos", "b"))
    return _files(rows, F.col("b.Name"), _size(F.col("b.Properties.`Content-Length`")), F.col("b.Properties.`Last-Modified`"), F.lit(""))


def azure_pages(bodies: DataFrame) -> DataFrame:
    x = bodies.withColumn("x", _xml(F.col("body"), AZURE_LISTING))
    name = F.coalesce(F.when(F.trim("x.ContainerName") != "", F.trim("x.ContainerName")), F.regexp_extract("x._ServiceEndpoint", r"([^/]+)/*$", 1))
    return x.select("base_url", name.alias("container_name"), F.when(F.col("x.NextMarker") != "", F.col("x.NextMarker")).alias("token"))


def host(url: Column) -> Column:
    """The network location of a URL; empty for a relative one."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def joined(base: Column, href: Column) -> Column:
    """href resolved against base: absolute, scheme-relative, rooted or relative, without dot segments."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.concat(scheme, F.lit("://"), host(base))
    folder = F.regexp_replace(F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", ""), r"[^/]*$", "")
    path = F.when(href.startswith("/"), href).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), href))
    tail = F.regexp_extract(path, r"([?#].*)$", 1)
    parts = F.split(F.regexp_replace(path, r"[?#].*$", ""), "/", -1)
    kept = F.aggregate(
        F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(p == ".", acc).otherwise(F.concat(acc, F.array(p))),
    )
    open_end = F.element_at(parts, -1).isin(".", "..")
    resolved = F.concat(root, F.lit("/"), F.array_join(kept, "/"), F.when(open_end & (F.size(kept) > 0), "/").otherwise(""), tail)
    return F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, F.lit(":"), href)).otherwise(resolved)


def links(pages: DataFrame, ignored: tuple[str, ...] = tables.IGNORED) -> DataFrame:
    """position, url, key, is_directory of the links of pages (base_url, html), beside the pages' other columns: the first of equal ones, none to other hosts, to parents or to ignored paths."""
    rest = [c for c in pages.columns if c != "html"]
    found = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lambda h: F.trim(h)))
    rows = pages.select(*rest, F.posexplode(found).alias("position", "href"))
    keep = ~F.col("href").isin("", "../", "./", "#") & ((host(F.col("href")) == "") | (host(F.col("href")) == host(F.col("base_url"))))
    for fragment in ignored:
        keep = keep & ~F.col("href").contains(fragment)
    url = joined(F.col("base_url"), F.col("href"))
    return rows.where(keep).select(*rest, "position", url.alias("url"), F.regexp_replace(scalars.url_path(url), r"^/+", "").alias("key"), F.col("href").endswith("/").alias("is_directory"))


def crawl(edges: DataFrame, roots: DataFrame, max_depth: int = 15) -> DataFrame:
    """url, depth: the least depth, at most ``max_depth``, at which each page is reached over edges (src, dst) from roots (url).

    A frontier per level, less what was visited; each level is one join and one anti-join and is checkpointed.
    """
    steps = checkpointed(edges.select("src", "dst").where("src <> dst").distinct())
    seen = frontier = roots.select("url").distinct().withColumn("depth", F.lit(0))
    for depth in range(1, max_depth + 1):
        reached = steps.join(frontier, F.col("src") == F.col("url"), "left_semi").select(F.col("dst").alias("url")).distinct()
        frontier = checkpointed(reached.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def listed(bodies: DataFrame) -> DataFrame:
    """Files of listings of any kind (base_url, body, container_type): S3 and GCS, Azure, or links of a page; the kind decides how a body is read."""
    of = lambda *kinds: bodies.where(F.col("container_type").isin(*kinds)).drop("container_type")
    s3, azure = ("AWS S3", "Google Cloud Storage"), ("Azure Blob Storage",)
    pages = bodies.where(~F.coalesce("container_type", F.lit("")).isin(*s3, *azure)).select("base_url", F.col("body").alias("html"))
    return s3_files(of(*s3)).unionByName(azure_files(of(*azure))).unionByName(linked_files(pages))


def linked_files(pages: DataFrame) -> DataFrame:
    """Files among the links of pages (base_url, html); a page tells neither size nor time."""
    found = links(pages).where(~F.col("is_directory"))
    none = {"size_bytes": F.lit(0).cast("long"), "last_modified": F.lit(""), "etag": F.lit(""), "ordinal": F.col("position").cast("long")}
    return found.withColumns(none).select("base_url", "url", "key", "size_bytes", "last_modified", "etag", "ordinal").withColumn("file_type", scalars.file_type(F.col("url")))


def fetched(urls: DataFrame, fetch: Callable[[str], str]) -> DataFrame:
    """base_url, html, error of each url; ``fetch`` runs where the rows are, and a page that cannot be had is an error, not the end."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for url in frame["url"]:
                try:
                    rows.append((url, fetch(url), None))
                except (OSError, ValueError) as e:
                    rows.append((url, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["base_url", "html", "error"])

    return urls.select("url").mapInPandas(run, "base_url string, html string, error string")


def crawl_pages(roots: DataFrame, fetch: Callable[[str], str], max_depth: int = 15) -> DataFrame:
    """base_url, url, key, ..., depth of the files that link pages lead to from roots (url), directory by directory; each is fetched once.

    A level is one fetch of its pages, stored, and one anti-join with what was visited.
    """
    seen = frontier = checkpointed(roots.select("url").distinct())
    found = None
    for depth in range(max_depth + 1):
        pages = checkpointed(fetched(frontier, fetch)).where(F.col("html").isNotNull()).select("base_url", "html")
        files = linked_files(pages).withColumn("depth", F.lit(depth))
        found = files if found is None else found.unionByName(files)
        frontier = checkpointed(links(pages).where("is_directory").select("url").distinct().join(seen, "url", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return found.dropDuplicates(["url"])


def read_bodies(spark: SparkSession, path: str, base_url: str) -> DataFrame:
    """base_url, body of stored listing or page bodies, a file each."""
    return spark.read.text(path, wholetext=True).select(F.lit(base_url).alias("base_url"), F.col("value").alias("body"))


def read_objects(spark: SparkSession, path: str, max_bytes: int = 20 * 1024 * 1024) -> DataFrame:
    """file_url, size_bytes, content (bytes) of stored objects. Larger ones are dropped by their length, before they are read."""
    rows = spark.read.format("binaryFile").load(path).where(F.col("length") <= max_bytes)
    return rows.select(F.col("path").alias("file_url"), F.col("length").alias("size_bytes"), "content")


def decoded(objects: DataFrame) -> DataFrame:
    """objects with their content as text; malformed bytes become U+FFFD."""
    return objects.withColumn("content", F.make_valid_utf8(F.col("content").cast("string")))
