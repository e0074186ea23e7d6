"""Token counts of documents in flat, unindexed token files, by a scan for the end-of-document id.

A flat file is nothing but ids of a fixed width, one document after another, each with the end id behind it. Files are cut
into blocks of a fixed number of ids, which tasks search by themselves, whatever the files' lengths: a block gives the
places of its separators. A prefix scan over one row per block (how many separators came before, where the last one
was) then tells each block's first document where it began, and numbers the documents of a file.

Defined results: ids behind a file's last separator are an open document (``closed`` false); a file that ends with a
separator has none; an empty file has no rows; two separators in a row enclose a document of 0 tokens. For the documents
table: a null or empty text counts 0 tokens, null doc_ids stay null, repeated rows are counted one by one, an empty table
gives no rows, other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaymark.llm import bpe, files
from quaymark.llm.shared import fresh, lean, pieces_of, written

#: The vocabulary's own end-of-document id: no text encodes to it, as special strings in texts are ordinary there.
END = 50256
#: Ids in a block.
BLOCK = 1 << 20


def write_flat(docs: DataFrame, folder: str, vocabulary: str | None = None, end: int = END, dtype: str = "<u2") -> DataFrame:
    """Writes each task's documents as one flat file; returns file, nth, doc_id: which document is where, but no place or size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe.encoder(vocabulary or bpe.default_path()).encode
        uri = f"{folder}/part-{TaskContext.get().partitionId():08d}.bin"
        held: list[pa.Array] = []

        def parts() -> Iterator[bytes]:
            for batch in batches:
                for piece in pieces_of(batch):
                    held.append(piece.column("doc_id"))
                    yield encode(piece.column("text"), end)[0].astype(dtype).tobytes()

        files.write_whole(uri, parts())
        ids = pa.concat_arrays([pa.array([], pa.int64()), *held])
        yield pa.RecordBatch.from_arrays([pa.array([uri] * len(ids), pa.string()), pa.array(np.arange(len(ids))), ids], names=["file", "nth", "doc_id"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "file string, nth long, doc_id long")


def blocks_of(spark: SparkSession, uris: DataFrame, width: int, block: int = BLOCK) -> DataFrame:
    """file, block, first, n_ids for all blocks of the files in the column ``file``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("file").to_pylist():
                n = files.size_of(uri) // width
                first = np.arange(0, n, block)
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(first), pa.string()), pa.array(np.arange(len(first))), pa.array(first), pa.array(np.minimum(block, n - first))], names=["file", "block", "first", "n_ids"])

    return uris.select("file").mapInArrow(lean(run), "file string, block long, first long, n_ids long")


def search(blocks: DataFrame, end: int, dtype: str) -> DataFrame:
    """The separators' places in each block."""
    width = np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, k, first, n in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "first", "n_ids")), strict=True):
                found = first + np.flatnonzero(np.frombuffer(files.read_range(uri, first * width, n * width), dtype) == end)
                yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([k]), pa.array([first + n]), pa.array([found.tolist()], pa.list_(pa.int64()))], names=["file", "block", "stop", "places"])

    return blocks.mapInArrow(lean(run), "file string, block long, stop long, places array<long>")


def count_tokens(spark: SparkSession, uris: DataFrame, end: int = END, dtype: str = "<u2", block: int = BLOCK) -> DataFrame:
    """file, nth, start, n_tokens, closed for each document of the files in the column ``file``."""
    listed = blocks_of(spark, uris, np.dtype(dtype).itemsize, block)
    # Blocks are dealt anew, so a large file is searched by many tasks.
    found = written(search(listed.repartition(F.col("file"), F.col("block")), end, dtype), "separators")
    short = found.select("file", "block", "stop", F.size("places").alias("n"), F.try_element_at("places", F.lit(-1)).alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = short.select(
        "file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("nth0"), (F.coalesce(F.max("last").over(before), F.lit(-1)) + 1).alias("start0"), F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull().alias("final")
    )
    joined = found.join(scanned, ["file", "block"])
    closed = joined.select("file", F.posexplode(F.expr("transform(places, (p, i) -> named_struct('start', if(i = 0, start0, places[i - 1] + 1), 'stop', p))")).alias("i", "d"), "nth0")
    out = closed.select("file", (F.col("nth0") + F.col("i")).alias("nth"), F.col("d.start").alias("start"), (F.col("d.stop") - F.col("d.start")).alias("n_tokens"), F.lit(True).alias("closed"))
    begun = F.coalesce(F.try_element_at("places", F.lit(-1)) + 1, F.col("start0"))
    still = joined.where(F.col("final") & (begun < F.col("stop"))).select("file", (F.col("nth0") + F.size("places")).alias("nth"), begun.alias("start"), (F.col("stop") - begun).alias("n_tokens"), F.lit(False).alias("closed"))
    return out.unionByName(still)


def document_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, file, nth, start, n_tokens of every document: written flat, then counted by the scan alone."""
    spark = docs.sparkSession
    who = written(write_flat(docs, fresh(spark, "flat"), vocabulary), "sidecar")
    counted = count_tokens(spark, who.select("file").distinct())
    joined = counted.join(who, ["file", "nth"])
    return joined.select("doc_id", F.regexp_extract("file", r"([^/]+)$", 1).alias("file"), "nth", "start", "n_tokens", "closed")
