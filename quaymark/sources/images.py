"""EXIF tags of JPEG and TIFF images, read from their bytes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from quaymark.operators.exif import TAGS

# Tag numbers that findings look at.
NAMES = {0x010D: "DocumentName", 0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0131: "Software", 0x013B: "Artist", 0x013C: "HostComputer", 0x000B: "ProcessingSoftware", 0x8298: "Copyright", 0x9286: "UserComment", 0xA430: "CameraOwnerName"}
EXIF_IFD, GPS_IFD = 0x8769, 0x8825
# Bytes of each field type.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def tiff_block(data: bytes) -> bytes | None:
    """The TIFF structure inside an image, if there is one."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return data[at + 10 : at + 2 + size]
        if marker == 0xDA:
            return None
        at += 2 + size
    return None


def directory(block: bytes, at: int, order: str) -> dict[int, object]:
    """The fields of one directory; fields that point outside the block are left out."""
    out: dict[int, object] = {}
    if at + 2 > len(block):
        return out
    (n,) = struct.unpack_from(f"{order}H", block, at)
    for i in range(n):
        p = at + 2 + 12 * i
        if p + 12 > len(block):
            break
        tag, kind, count = struct.unpack_from(f"{order}HHI", block, p)
        size = SIZES.get(kind, 0) * count
        if not size:
            continue
        start = p + 8 if size <= 4 else struct.unpack_from(f"{order}I", block, p + 8)[0]
        raw = block[start : start + size]
        if len(raw) < size:
            continue
        if kind == 2:
            out[tag] = raw.split(b"\0")[0].decode("utf-8", "replace")
        elif kind == 7:
            out[tag] = raw.lstrip(b"ASCII\0").rstrip(b"\0 ").decode("utf-8", "replace") if raw[:5] == b"ASCII" else raw.decode("utf-8", "replace")
        elif kind in (3, 4, 9):
            out[tag] = struct.unpack(f"{order}{count}{ {3: 'H', 4: 'I', 9: 'i'}[kind] }".replace(" ", ""), raw)
        elif kind in (5, 10):
            v = struct.unpack(f"{order}{2 * count}{'I' if kind == 5 else 'i'}", raw)
            out[tag] = tuple(a / b if b else None for a, b in zip(v[::2], v[1::2], strict=True))
    return out


def exif(data: bytes) -> tuple[dict[str, str], dict | None]:
    """(tags by name, position or None) of an image; nothing for what cannot be read."""
    block = tiff_block(data)
    if not block or len(block) < 8:
        return {}, None
    order = "<" if block[:2] == b"II" else ">"
    main = directory(block, struct.unpack_from(f"{order}I", block, 4)[0], order)
    fields = dict(main)
    if isinstance(main.get(EXIF_IFD), tuple):
        fields |= directory(block, main[EXIF_IFD][0], order)
    tags = {name: str(fields[k]) for k, name in NAMES.items() if k in fields and isinstance(fields[k], str)}
    if not isinstance(main.get(GPS_IFD), tuple):
        return tags, None
    gps = directory(block, main[GPS_IFD][0], order)
    place = lambda ref, value: dict(zip("dms", [*(gps.get(value) or ()), None, None, None], strict=False)) | {"ref": gps.get(ref)}
    return tags, {"lat": place(1, 2), "lon": place(3, 4)}


def read(objects: DataFrame) -> DataFrame:
    """file_url, tags, gps of objects (file_url, content) that hold any EXIF data."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(u, *exif(bytes(d or b""))) for u, d in zip(frame["file_url"], frame["content"], strict=True)]
            yield pd.DataFrame([r for r in rows if r[1] or r[2]], columns=["file_url", "tags", "gps"])

    return objects.select("file_url", "content").mapInPandas(run, TAGS)
