"""Archives, images, listings and links from inputs made here."""

import bz2
import gzip
import io
import struct
import tarfile
import zipfile
from urllib.parse import parse_qs, urljoin, urlsplit

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quaymark.sources import archives, datasource, images, listings


def zipped(members):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return held.getvalue()


def tarred(members, mode="w:gz"):
    held = io.BytesIO()
    with tarfile.open(fileobj=held, mode=mode) as t:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return held.getvalue()


MEMBERS = {"a/.env": b"K=1", "./b.py": b"x = 1\n", "../up": b"no", "/abs": b"no", "n.py": b"\0" * 50 + b"x", "in.zip": zipped({"q.txt": b"deep"}), "e.txt": b"", "bad.txt": b"\xff\xfeok"}


def test_members():
    want = {"a/.env": b"K=1", "b.py": b"x = 1\n", "n.py": MEMBERS["n.py"], "in.zip": MEMBERS["in.zip"], "e.txt": b"", "bad.txt": b"\xff\xfeok"}
    assert dict(archives.members("https://h/x.zip", zipped(MEMBERS))) == dict(archives.members("y.tar.gz", tarred(MEMBERS))) == want
    assert dict(archives.members("y.tar.bz2", tarred(MEMBERS, "w:bz2"))) == want
    assert list(archives.members("d/data.sql.gz", gzip.compress(b"select 1"))) == [("data.sql", b"select 1")]
    assert list(archives.members("a.bz2", bz2.compress(b"z"))) == [("a", b"z")]
    assert dict(archives.members("backup.v1.zip", zipped({"k": b"v"}))) == {"k": b"v"}
    for name, data in (("a.7z", b"7z"), ("a.zip", b"no zip"), ("a.tar", b"no tar")):
        with pytest.raises((ValueError, zipfile.BadZipFile, tarfile.TarError)):
            list(archives.members(name, data))


def test_caps(monkeypatch):
    data = zipped({f"{i}.txt": b"x" * 10 for i in range(20)})
    monkeypatch.setattr(archives, "MAX_MEMBERS", 5)
    assert len(list(archives.members("a.zip", data))) == 5
    monkeypatch.setattr(archives, "MAX_TOTAL_BYTES", 35)
    assert len(list(archives.members("a.zip", data))) == 3
    monkeypatch.setattr(archives, "MAX_MEMBER_BYTES", 9)
    assert list(archives.members("a.zip", data)) == []


@given(st.text(alphabet="ab./\\", max_size=12))
@settings(deadline=None)
def test_no_path_leaves_the_archive(raw):
    path = archives.safe_path(raw)
    assert path is None or (".." not in path.split("/") and not path.startswith("/") and path)


def test_unpacked(spark):
    rows = [("https://h/a.zip", zipped(MEMBERS)), ("https://h/b.zip", b"broken"), ("https://h/c.zip", None)]
    objects = spark.createDataFrame(rows, "file_url string, content binary")
    out = archives.unpacked(objects)
    assert {r.file_url for r in out.where("error is not null").collect()} == {"https://h/b.zip", "https://h/c.zip"}
    texts = {r.file_url: (r.file_type, r.content) for r in archives.texts(out).collect()}
    assert texts == {"https://h/a.zip!/a/.env": ("Environment", "K=1"), "https://h/a.zip!/b.py": ("Python", "x = 1\n"), "https://h/a.zip!/e.txt": ("Other", ""), "https://h/a.zip!/bad.txt": ("Other", "��ok")}


def tiff(order="<", gps=True):
    """A TIFF block with a maker, an artist and a position."""
    heap, base = b"", 8 + 2 + 12 * (3 if gps else 2) + 4
    entries = []

    def put(tag, kind, count, raw):
        nonlocal heap
        if len(raw) <= 4:
            return struct.pack(f"{order}HHI", tag, kind, count) + raw.ljust(4, b"\0")
        at = base + len(heap)
        heap += raw
        return struct.pack(f"{order}HHII", tag, kind, count, at)

    entries.append(put(0x010F, 2, 8, b"Maker 1\0"))
    entries.append(put(0x013B, 2, 4, b"Eve\0"))
    if gps:
        def rational(*v):
            return b"".join(struct.pack(f"{order}II", x, 1) for x in v)

        at = base + len(heap)
        inner = at + 2 + 12 * 4 + 4
        fields = struct.pack(f"{order}H", 4) + struct.pack(f"{order}HHI", 1, 2, 2) + b"N\0\0\0" + struct.pack(f"{order}HHII", 2, 5, 3, inner) + struct.pack(f"{order}HHI", 3, 2, 2) + b"W\0\0\0" + struct.pack(f"{order}HHII", 4, 5, 3, inner + 24) + b"\0" * 4
        heap += fields + rational(48, 51, 30) + rational(2, 17, 40)
        entries.append(struct.pack(f"{order}HHII", 0x8825, 4, 1, at))
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(f"{order}I", 8)
    return head + struct.pack(f"{order}H", len(entries)) + b"".join(entries) + b"\0" * 4 + heap


@pytest.mark.parametrize("order", "<>")
def test_exif(spark, order):
    from quaymark.operators import exif

    block = tiff(order)
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(block) + 8) + b"Exif\0\0" + block + b"\xff\xda\0\2"
    assert images.exif(jpeg) == images.exif(block) == ({"Make": "Maker 1", "Artist": "Eve"}, {"lat": {"d": 48.0, "m": 51.0, "s": 30.0, "ref": "N"}, "lon": {"d": 2.0, "m": 17.0, "s": 40.0, "ref": "W"}})
    for junk in (b"", b"\xff\xd8", b"\xff\xd8\xff\xe1\0\4", block[:20], block[: len(block) // 2], b"GIF89a"):
        images.exif(junk)
    rows = [("https://h/a.jpg", jpeg), ("https://h/b.tiff", tiff(order, gps=False)), ("https://h/c.jpg", b"junk"), ("https://h/d.jpg", None)]
    found = exif.findings(images.read(spark.createDataFrame(rows, "file_url string, content binary"))).collect()
    assert {(r.file_name, r.rule_name, r.match) for r in found} == {("a.jpg", "IMAGE_GPS_COORDINATES", "48.85833, -2.29444"), ("a.jpg", "IMAGE_DEVICE_INFO", "Make=Maker 1"), ("a.jpg", "IMAGE_AUTHOR_INFO", "Artist=***"), ("b.tiff", "IMAGE_DEVICE_INFO", "Make=Maker 1"), ("b.tiff", "IMAGE_AUTHOR_INFO", "Artist=***")}


def test_links(spark):
    page = '<title>Index of /</title><a href="../">up</a><a href="sub/">s</a><a href="a.env">a</a><a href="https://other/x">o</a><a href="?C=N">n</a><a href="a.env">again</a><a href=".git/x">g</a>'
    got = listings.links(spark.createDataFrame([("https://h/", page), ("https://h/e", None)], "base_url string, html string")).collect()
    assert {(r.url, r.key, r.is_directory) for r in got} == {("https://h/sub/", "sub/", True), ("https://h/a.env", "a.env", False)}


@pytest.mark.parametrize("base", ["https://h/a/b/c.html", "https://h/a/b/", "https://h", "http://h:8/x?q=/y"])
def test_urljoin(spark, base):
    refs = ["x", "./x", "../x", "../../../x", "/r/s", "//o/p", "https://z/q", "x/", "../", "a/./b/../c", "x?y=1", "mailto:a"]
    rows = spark.createDataFrame([(r,) for r in refs], "r string")
    got = {r.r: r.u for r in rows.select("r", listings.joined(F.lit(base), F.col("r")).alias("u")).collect()}
    assert got == {r: urljoin(base, r) for r in refs}


def test_listing_source(spark, monkeypatch):
    from quaymark.plans.queries import S3_BODY

    files, prefixes, token = datasource.parse_page(S3_BODY)
    assert (files, prefixes, token) == ([("app/.env", 120, "2024-01-01T00:00:00Z", "abc"), ("x.js", 0, "", "")], ["logs/"], "tok")
    pages = {"": S3_BODY, "tok": "<R><Contents><Key>y</Key><Size>1</Size></Contents></R>", "logs/": "<R><IsTruncated>false</IsTruncated><Contents><Key>logs/l</Key></Contents></R>"}
    monkeypatch.setattr(datasource, "fetch", lambda url: pages["tok" if "continuation" in url else "logs/" if "prefix" in url else ""])
    reader = datasource.ObjectListing({"url": "https://b/"}).reader(None)
    assert [r[1] for p in reader.partitions() for r in reader.read(p)] == ["app/.env", "x.js", "y", "logs/l"]


def test_azure_listing_source(monkeypatch):
    """Level by level to partitions, page by page within one; a marker leads to the next page."""
    blob = lambda k: f"<Blob><Name>{k}</Name><Properties><Content-Length>3</Content-Length><Last-Modified>x</Last-Modified></Properties></Blob>"
    page = lambda blobs, subs=(), marker="": f"<EnumerationResults><Blobs>{''.join(map(blob, blobs))}{''.join(f'<BlobPrefix><Name>{s}</Name></BlobPrefix>' for s in subs)}</Blobs><NextMarker>{marker}</NextMarker></EnumerationResults>"
    tree = ["a.txt", "b.txt", "d/c.txt", "d/e/f.txt", "g/h.txt", "g/i/", "g/j.txt"]
    asked = []

    def fetch(url):
        q = {k: v[0] for k, v in parse_qs(urlsplit(url).query).items()}
        assert q["restype"] == "container" and q["comp"] == "list"
        asked.append(q)
        prefix = q.get("prefix", "")
        found = [k for k in tree if k.startswith(prefix)]
        if "delimiter" in q:
            subs = sorted({prefix + k[len(prefix) :].partition("/")[0] + "/" for k in found if "/" in k[len(prefix) :]})
            found = [k for k in found if "/" not in k[len(prefix) :]]
        else:
            subs = []
        at = int(q.get("marker", 0))
        return page(found[at : at + 1], subs if not at else [], str(at + 1) if at + 1 < len(found) else "")

    monkeypatch.setattr(datasource, "fetch", fetch)
    for split in (1, 2, 16):
        reader = datasource.ObjectListing({"url": "https://acct.blob.core.windows.net/c", "split": str(split)}).reader(None)
        parts = reader.partitions()
        assert len(parts) >= min(split, 3)
        assert sorted(r[1] for p in parts for r in reader.read(p)) == sorted(k for k in tree if not k.endswith("/"))
    assert any("marker" in q for q in asked)
    with pytest.raises(ValueError):
        datasource.listing_of("https://h", "ftp")


def test_listings_by_kind(spark):
    from quaymark.plans.queries import AZURE_BODY, S3_BODY

    rows = [("https://b/", S3_BODY, "AWS S3"), ("https://a/cont", AZURE_BODY, "Azure Blob Storage"), ("https://h/", '<a href="k.env">k</a><a href="sub/">s</a>', "Open Directory Listing"), ("https://n/", None, None)]
    got = listings.listed(spark.createDataFrame(rows, "base_url string, body string, container_type string")).collect()
    assert {(r.base_url, r.key, r.file_type) for r in got} == {("https://b/", "app/.env", "Environment"), ("https://b/", "x.js", "JavaScript"), ("https://a/cont", "k.sql", "SQL / Database Dump"), ("https://h/", "k.env", "Environment")}


def test_links_of_equal_pages(spark):
    """Pages with one address keep their own links, and their other columns."""
    rows = [(1, "https://h/", '<a href="a">a</a>'), (2, "https://h/", '<a href="b">b</a>')]
    assert {(r.page_id, r.key) for r in listings.links(spark.createDataFrame(rows, "page_id int, base_url string, html string")).collect()} == {(1, "a"), (2, "b")}


def test_crawl_of_pages(spark):
    site = {"https://h/": '<a href="a.txt">a</a><a href="s/">s</a><a href="broken/">b</a>', "https://h/s/": '<a href="b.env">b</a><a href="../">up</a><a href="/">root</a><a href="t/">t</a>', "https://h/s/t/": '<a href="c.py">c</a>'}

    def fetch(url):
        if url not in site:
            raise OSError("404")
        return site[url]

    roots = spark.createDataFrame([("https://h/",)], "url string")
    assert {(r.url, r.depth) for r in listings.crawl_pages(roots, fetch).collect()} == {("https://h/a.txt", 0), ("https://h/s/b.env", 1), ("https://h/s/t/c.py", 2)}
    assert {r.url for r in listings.crawl_pages(roots, fetch, 0).collect()} == {"https://h/a.txt"}
    assert [r.error for r in listings.fetched(spark.createDataFrame([("https://h/broken/",)], "url string"), fetch).collect()] == ["OSError: 404"]


def test_archives_with_odd_names(spark):
    """An archive's own address may hold what parts members from archives; its other columns reach its members."""
    rows = [("https://h/a!/b.zip", 7, zipped({"x.py": b"mail a@example.org"})), ("https://h/c.zip", 8, b"broken"), ("https://h/d.gz", 9, gzip.compress(b"t"))]
    objects = spark.createDataFrame(rows, "file_url string, ordinal long, content binary")
    got = archives.texts(archives.unpacked(objects)).collect()
    assert {(r.file_url, r.ordinal) for r in got} == {("https://h/a!/b.zip!/x.py", 7), ("https://h/d.gz!/d", 9)}
    assert [(r.file_url, r.ordinal) for r in archives.unreadable(objects).collect()] == [("https://h/c.zip", 8)]


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"caf\xc3\xa9 \xff")
    (tmp_path / "b.txt").write_bytes(b"x" * 100)
    objects = listings.read_objects(spark, str(tmp_path), 50)
    assert [(r.size_bytes, r.content) for r in listings.decoded(objects).collect()] == [(7, "café �")]
    assert {r.body for r in listings.read_bodies(spark, str(tmp_path), "https://b").collect()} == {"café �", "x" * 100}


def test_crawl_of_a_cycle(spark):
    edges = spark.createDataFrame([("r", "a"), ("a", "r"), ("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")], "src string, dst string")
    got = {r.url: r.depth for r in listings.crawl(edges, spark.createDataFrame([("r",)], "url string"), 3).collect()}
    assert got == {"r": 0, "a": 1, "b": 2, "c": 3}
