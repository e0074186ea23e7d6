"""A Spark data source for object listings: ``spark.read.format("object_listing").option("url", ...)``.

Options: ``url``; ``provider``: s3 (and what lists like it), azure, or auto (by the host name); ``prefixes``, separated by commas; ``split``:
the driver lists levels of prefixes until there are so many partitions. A partition lists one prefix, page by page: all
below it, or only what lies at its own level if its sub-prefixes are partitions too. TLS certificates are checked, and requests
are retried with doubling pauses.
"""

from __future__ import annotations

import re
import time
import urllib.parse
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ATTEMPTS, PAUSE, TIMEOUT, SPLIT = 3, 1.5, 30, 16
AZURE_HOST = r"^https?://[^/]*\.blob\.core\.windows\.net(?:/|$)"
Page = tuple[list[tuple[str, int, str, str]], list[str], str | None]


def _root(body: str) -> ET.Element:
    root = ET.fromstring(body)
    for element in root.iter():
        element.tag = element.tag.rpartition("}")[2]
    return root


def _size(text: str) -> int:
    return int(text) if text.isdigit() else 0


def parse_page(body: str) -> Page:
    """(files, prefixes, token for the next page) of an S3-style listing."""
    root = _root(body)
    files = []
    for item in root.iterfind("Contents"):
        key, size, modified, etag = (item.findtext(k, "") for k in ("Key", "Size", "LastModified", "ETag"))
        if key and not key.endswith("/"):
            files.append((key, _size(size), modified, etag.strip('"')))
    more = root.findtext("IsTruncated", "false").lower() == "true"
    token = root.findtext("NextContinuationToken") or root.findtext("NextMarker")
    return files, [p.text for p in root.iterfind("CommonPrefixes/Prefix") if p.text], token if more and token else None


def parse_azure_page(body: str) -> Page:
    """The same of an Azure container's listing."""
    root = _root(body)
    files = []
    for item in root.iterfind("Blobs/Blob"):
        key, size, modified, etag = (item.findtext(k, "") for k in ("Name", "Properties/Content-Length", "Properties/Last-Modified", "Properties/Etag"))
        if key and not key.endswith("/"):
            files.append((key, _size(size), modified, etag.strip('"')))
    return files, [p.text for p in root.iterfind("Blobs/BlobPrefix/Name") if p.text], root.findtext("NextMarker") or None


def fetch(url: str, timeout: float = TIMEOUT) -> str:
    for attempt in range(ATTEMPTS):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as reply:
                return reply.read().decode("utf-8", "replace")
        except OSError:
            if attempt == ATTEMPTS - 1:
                raise
            time.sleep(PAUSE * 2**attempt)
    return ""


class S3:
    """How pages of a listing are asked for and read."""

    def __init__(self, base: str):
        self.base = base

    def url(self, prefix: str, token: str | None, deep: bool) -> str:
        query = {"list-type": "2"} | ({} if deep else {"delimiter": "/"}) | ({"prefix": prefix} if prefix else {}) | ({"continuation-token": token} if token else {})
        return f"{self.base}/?{urllib.parse.urlencode(query)}"

    parse = staticmethod(parse_page)


class Azure(S3):
    def url(self, prefix: str, token: str | None, deep: bool) -> str:
        query = {"restype": "container", "comp": "list"} | ({} if deep else {"delimiter": "/"}) | ({"prefix": prefix} if prefix else {}) | ({"marker": token} if token else {})
        return f"{self.base}?{urllib.parse.urlencode(query)}"

    parse = staticmethod(parse_azure_page)


def listing_of(base: str, provider: str = "auto") -> S3:
    """The kind of listing that a provider, or a host name, has."""
    if provider == "auto":
        provider = "azure" if re.match(AZURE_HOST, base) else "s3"
    if provider not in ("s3", "azure"):
        raise ValueError("provider must be auto, s3 or azure")
    return (Azure if provider == "azure" else S3)(base)


class Prefix(InputPartition):
    def __init__(self, prefix: str, deep: bool = True):
        self.prefix, self.deep = prefix, deep


class ListingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.listing = listing_of(options["url"].rstrip("/"), options.get("provider", "auto"))
        self.prefixes = [p for p in options.get("prefixes", "").split(",") if p] or [""]
        self.split = int(options.get("split", SPLIT))

    def _pages(self, prefix: str, deep: bool) -> Iterator[Page]:
        token: str | None = None
        while True:
            page = self.listing.parse(fetch(self.listing.url(prefix, token, deep)))
            yield page
            token = page[2]
            if not token:
                return

    def partitions(self) -> list[Prefix]:
        """Level by level, each prefix gives way to its own level and its sub-prefixes, until there are ``split``."""
        done, level = [], [Prefix(p) for p in self.prefixes]
        while level and len(done) + len(level) < self.split:
            below = []
            for part in level:
                subs = [p for page in self._pages(part.prefix, deep=False) for p in page[1] if p != part.prefix]
                done.append(Prefix(part.prefix, deep=not subs))
                below += [Prefix(p) for p in dict.fromkeys(subs)]
            level = below
        return done + level

    def read(self, partition: Prefix) -> Iterator[tuple]:
        for files, _, _ in self._pages(partition.prefix, partition.deep):
            for key, size, modified, etag in files:
                yield f"{self.listing.base}/{key.lstrip('/')}", key, size, modified, etag


class ObjectListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "object_listing"

    def schema(self) -> str:
        return "url string, key string, size_bytes long, last_modified string, etag string"

    def reader(self, schema) -> ListingReader:
        return ListingReader(dict(self.options))
