"""Token-id files with Simple-8b words.

File: ``QMS8``, version; blocks of words, each of BLOCK ids and without regard to documents; a footer with the blocks'
offsets and counts and the documents' ids and sizes; the footer's place and counts. A reader can decode any block alone.
Files hold consecutive ranges of doc_id; a manifest row per file gives its rank and totals, so a file's first id in the
whole stream is a sum over one row per file.

Defined results: a null or empty text has the end id alone; null doc_ids come first; rows with equal doc_id are ordered by
their text, so reruns give the same files; an empty table gives no files and no rows; other columns are not read. A text
of any length is coded; it may span any number of blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.llm import bpe, files, simple8b
from quaymark.llm.shared import fresh, lean, pieces_of

MAGIC = b"QMS8"
_HEAD, _TAIL = struct.Struct("<4sI"), struct.Struct("<QQQ4s")
#: Ids that are coded, and blocks that are decoded, at a time.
AT_ONCE = 128
_BLOCK_ROW = np.dtype([("offset", "<u8"), ("words", "<u4"), ("ids", "<u4")])
_DOC_ROW = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("tokens", "<u8")])

MANIFEST = "file string, task long, n_docs long, n_ids long, n_bytes long"


class Writer:
    """Gathers ids and gives the file's bytes as they are ready; holds at most AT_ONCE blocks of ids."""

    def __init__(self) -> None:
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.offset = _HEAD.size
        self.blocks: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []

    def head(self) -> bytes:
        return _HEAD.pack(MAGIC, 1)

    def add(self, doc_ids: pa.Array, ids: np.ndarray, at: np.ndarray) -> Iterator[bytes]:
        rows = np.zeros(len(at) - 1, dtype=_DOC_ROW)
        rows["doc_id"], rows["known"] = pa.compute.fill_null(doc_ids, 0).to_numpy(zero_copy_only=False), pa.compute.is_valid(doc_ids).to_numpy(zero_copy_only=False)
        rows["tokens"] = np.diff(at)
        self.docs.append(rows)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= AT_ONCE * simple8b.BLOCK:
            all_ids = np.concatenate(self.held)
            whole = len(all_ids) // simple8b.BLOCK * simple8b.BLOCK
            self.held, self.n_held = [all_ids[whole:]], len(all_ids) - whole
            yield self._coded(all_ids[:whole])

    def _coded(self, ids: np.ndarray) -> bytes:
        words, counts, sizes = simple8b.encode(ids)
        rows = np.zeros(len(counts), dtype=_BLOCK_ROW)
        rows["offset"] = self.offset + 8 * (np.cumsum(counts) - counts)
        rows["words"], rows["ids"] = counts, sizes
        self.blocks.append(rows)
        self.offset += 8 * len(words)
        self.n_ids += len(ids)
        return words.astype("<u8").tobytes()

    def close(self) -> Iterator[bytes]:
        if self.n_held:
            yield self._coded(np.concatenate(self.held))
        blocks = np.concatenate([np.zeros(0, _BLOCK_ROW), *self.blocks])
        docs = np.concatenate([np.zeros(0, _DOC_ROW), *self.docs])
        self.n_docs = len(docs)
        yield blocks.tobytes()
        yield docs.tobytes()
        yield _TAIL.pack(self.offset, len(blocks), len(docs), MAGIC)


def read_footer(uri: str) -> tuple[np.ndarray, np.ndarray]:
    """(blocks, documents) of a file."""
    size = files.size_of(uri)
    offset, n_blocks, n_docs, magic = _TAIL.unpack(files.read_range(uri, size - _TAIL.size, _TAIL.size))
    if magic != MAGIC:
        raise ValueError(f"{uri} is no token file")
    raw = files.read_range(uri, offset, size - _TAIL.size - offset)
    cut = n_blocks * _BLOCK_ROW.itemsize
    return np.frombuffer(raw[:cut], _BLOCK_ROW), np.frombuffer(raw[cut:], _DOC_ROW)


def read_ids(uri: str, blocks: np.ndarray) -> np.ndarray:
    """The ids of consecutive blocks of a file."""
    if not len(blocks):
        return np.zeros(0, np.uint64)
    first = int(blocks["offset"][0])
    raw = files.read_range(uri, first, 8 * int(blocks["words"].astype(np.int64).sum()))
    return simple8b.decode(np.frombuffer(raw, "<u8"), blocks["words"].astype(np.int64), blocks["ids"].astype(np.int64))


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id and text, dealt out and sorted by doc_id. A hash and the text itself part rows of equal (or null) doc_id, so none of them needs one task."""
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    return held.repartitionByRange(*keys).sortWithinPartitions(*keys, F.col("text").asc_nulls_first())


def write_tokens(docs: DataFrame, folder: str, vocabulary: str | None = None) -> list:
    """Writes the documents' ids, each document's end id included, in ascending doc_id order; returns one manifest row per file, in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe.encoder(vocabulary or bpe.default_path()).encode
        task = TaskContext.get().partitionId()
        writer = Writer()

        def parts() -> Iterator[bytes]:
            yield writer.head()
            for batch in batches:
                for piece in pieces_of(batch):
                    ids, at = encode(piece.column("text"))
                    yield from writer.add(piece.column("doc_id"), ids, at)
            yield from writer.close()

        uri = f"{folder}/part-{task:08d}.qms8"
        n = files.write_whole(uri, parts())
        yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([task]), pa.array([writer.n_docs], pa.int64()), pa.array([writer.n_ids], pa.int64()), pa.array([n], pa.int64())], names=["file", "task", "n_docs", "n_ids", "n_bytes"])

    return sorted(in_order(docs).mapInArrow(lean(run), MANIFEST).where("n_docs > 0").collect(), key=lambda r: r["task"])


def read_tokens(spark: SparkSession, manifest: list) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the files."""
    if not manifest:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    first = np.cumsum([0, *(r["n_ids"] for r in manifest)])
    rows = [(r["file"], int(first[i]), i) for i, r in enumerate(manifest)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                yield from documents_of(uri, base)

    held = spark.createDataFrame(rows, "file string, base long, nth long")
    # A file is a task's work; the rows are dealt by their number, so tasks get as many each.
    return held.repartitionByRange(len(rows), "nth").mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def documents_of(uri: str, base: int) -> Iterator[pa.RecordBatch]:
    """The documents of one file, decoded AT_ONCE blocks at a time; a document's checksum is carried from block to block."""
    blocks, docs = read_footer(uri)
    ends = np.cumsum(docs["tokens"].astype(np.int64))
    starts = ends - docs["tokens"].astype(np.int64)
    crc = np.zeros(len(docs), dtype=np.int64)
    done, lo = 0, 0
    for i in range(0, len(blocks), AT_ONCE):
        ids = read_ids(uri, blocks[i : i + AT_ONCE])
        raw, hi = memoryview(ids.astype("<u4").tobytes()), lo + len(ids)
        d = done
        while d < len(docs) and starts[d] < hi:
            a, b = max(int(starts[d]), lo) - lo, min(int(ends[d]), hi) - lo
            crc[d] = zlib.crc32(raw[4 * a : 4 * b], int(crc[d]))
            if ends[d] > hi:
                break
            d += 1
        done, lo = d, hi
    ids = pa.array(docs["doc_id"].copy(), mask=docs["known"] == 0)
    yield pa.RecordBatch.from_arrays([ids, pa.array(base + starts), pa.array(docs["tokens"].astype(np.int64)), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    return read_tokens(spark, write_tokens(docs, fresh(spark, "tokens"), vocabulary))
