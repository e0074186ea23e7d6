"""Document fingerprints: quartile digests of hashed byte triplets.

Three triplets of each window of four bytes are hashed to 128 buckets. The digest has two bits per bucket, the quartile of
the buckets' counts that its count lies in, and a head with the length on a logarithmic scale and the ratios of the
quartiles. Two digests differ by the sum over their buckets' steps (three steps count six) and their heads' steps, bounded
by MOST_DIFFERENCE; their likeness is 1 less the difference's share of that bound.

For the successor of a document, documents are dealt out in ranges of doc_id. Within a range a task walks in order, with
one text held back; the first and last document of each range, two per task, meet in a small join.

Defined results: a null text is an empty one (0 code points; its digest has all bits 0); null doc_ids come first, rows of
equal doc_id follow their text's hash and then the text, so reruns agree; repeated rows follow each other; a table of one
document has itself as the next; an empty table gives no rows; other columns are not read. Whole texts count, at any length.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.llm import textkernel as K
from quaymark.llm.shared import lean, pieces_of, written
from quaymark.llm.token_files import in_order

BUCKETS = 128
#: Places of the triplets within a window.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
MOST_DIFFERENCE = 400
_STEP = np.array([0, 1, 2, 6])
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each text has each bucket, as rows."""
    n = len(offsets) - 1
    out = np.zeros((n + 1) * BUCKETS, dtype=np.int64)
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(n), sizes)
    left = np.repeat(offsets[1:], sizes) - np.arange(len(data))
    wide = data.astype(np.uint32)
    with np.errstate(over="ignore"):
        scaled = [wide * f for f in _FACTORS]
        for k, places in enumerate(TRIPLETS):
            m = len(data) - places[2]
            if m <= 0:
                continue
            x = scaled[0][:m] + scaled[1][places[1] : places[1] + m] + scaled[2][places[2] : places[2] + m] + np.uint32(0x27D4EB2F * k & 0xFFFFFFFF)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            bucket = (x >> np.uint32(25)).astype(np.int64)
            bucket += np.where(left[:m] > places[2], doc[:m], n) * BUCKETS
            out += np.bincount(bucket, minlength=len(out))
    return out[: n * BUCKETS].reshape(n, BUCKETS)


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of bytes: the length, both ratios, and 128 quartiles in 32 bytes."""
    held = counts(data, offsets)
    q1, q2, q3 = (np.partition(held, [31, 63, 95], axis=1)[:, [31, 63, 95]].T if len(held) else np.zeros((3, 0), np.int64))
    code = (held > q1[:, None]).astype(np.uint8) + (held > q2[:, None]) + (held > q3[:, None])
    body = code.reshape(len(held), BUCKETS // 4, 4)
    body = body[:, :, 0] << 6 | body[:, :, 1] << 4 | body[:, :, 2] << 2 | body[:, :, 3]
    length = np.minimum(255, np.floor(np.log1p(np.diff(offsets)) / math.log(1.2))).astype(np.uint8)
    top = np.maximum(q3, 1)
    ratio = ((15 * q1 // top) << 4 | (15 * q2 // top)).astype(np.uint8)
    return np.concatenate([length[:, None], ratio[:, None], body], axis=1)


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bounded difference of digests, row by row."""
    steps = np.zeros(len(a), dtype=np.int64)
    for shift in (0, 2, 4, 6):
        x, y = (a[:, 2:] >> shift & 3).astype(np.int64), (b[:, 2:] >> shift & 3).astype(np.int64)
        steps += _STEP[np.abs(x - y)].sum(axis=1)
    head_a, head_b = a[:, :2].astype(np.int64), b[:, :2].astype(np.int64)
    steps += 4 * np.minimum(16, np.abs(head_a[:, 0] - head_b[:, 0]))
    for shift in (0, 4):
        steps += 2 * np.abs((head_a[:, 1] >> shift & 15) - (head_b[:, 1] >> shift & 15))
    return np.minimum(steps, MOST_DIFFERENCE)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1.0 - difference(a, b) / MOST_DIFFERENCE


def digests_of(column: pa.Array) -> np.ndarray:
    return fingerprints(*K.buffer_of(column))


def edited(texts: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """(edited texts, code points) of all texts but the last: the last half of the code points gives way to the first ones of the next text."""
    data, offsets = K.buffer_of(texts)
    first = np.flatnonzero((data & 0xC0) != 0x80)
    cut = np.searchsorted(first, offsets)
    at = np.append(first, len(data))
    n = np.diff(cut)
    half = n[:-1] // 2
    keep = at[cut[:-2] + n[:-1] - half]
    keep = np.where(half == 0, offsets[1:-1], keep)
    take = np.minimum(half, n[1:])
    upto = np.where(take == n[1:], offsets[2:], at[np.minimum(cut[1:-1] + take, len(at) - 1)])
    raw = data.tobytes()
    return [raw[a:b] + raw[b2:c] for a, b, b2, c in zip(offsets[:-2].tolist(), keep.tolist(), offsets[1:-1].tolist(), upto.tolist(), strict=True)], n


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(doc_ids: pa.Array, texts: pa.Array) -> list[pa.Array]:
    """The result's columns for all documents but the last; ``texts`` has one more, the next document."""
    changed, n = edited(texts)
    own, new = digests_of(texts), digests_of(pa.array(changed, pa.binary()))
    text = lambda rows: pa.array([r.tobytes().hex() for r in rows], pa.string())
    return [doc_ids, pa.array(n[:-1], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in changed], pa.string()), text(own[:-1]), text(new), pa.array(likeness(own[:-1], new)), pa.array(likeness(own[:-1], own[1:]))]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind 0 are results; the task's first and last document are rows of kind 1 and 2 with their texts."""
    task = TaskContext.get().partitionId()
    held: pa.RecordBatch | None = None
    names = ["kind", "task", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "text"]

    def edge(kind: int, row: pa.RecordBatch) -> pa.RecordBatch:
        empty = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([task], pa.int64()), row.column("doc_id"), *empty, row.column("text")], names=names)

    for batch in batches:
        for part in pieces_of(batch):
            if held is None:
                yield edge(1, part.slice(0, 1))
                both = part
            else:
                both = pa.concat_batches([held, part])
            if both.num_rows > 1:
                n = both.num_rows - 1
                columns = _pairs(both.column("doc_id").slice(0, n), both.column("text"))
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, task)), *columns, pa.nulls(n, pa.string())], names=names)
            held = both.slice(both.num_rows - 1)
    if held is not None:
        yield edge(2, held)


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every document."""
    spark: SparkSession = docs.sparkSession
    walked = written(in_order(docs).mapInArrow(lean(_walk), f"kind int, task long, {RESULT}, text string"), "digests")
    edges = walked.where("kind > 0").select("kind", "task", "doc_id", "text")
    tasks = sorted(r["task"] for r in edges.where("kind = 1").select("task").collect())  # one number per task
    following = spark.createDataFrame([(t, tasks[(i + 1) % len(tasks)]) for i, t in enumerate(tasks)], "task long, next_task long")
    firsts = edges.where("kind = 1").select(F.col("task").alias("next_task"), F.col("text").alias("next_text"))
    lasts = edges.where("kind = 2").select("task", "doc_id", "text").join(following, "task").join(firsts, "next_task").select("doc_id", "text", "next_text")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                texts = pa.concat_arrays([pc.fill_null(one.column("text"), ""), pc.fill_null(one.column("next_text"), "")])
                yield pa.RecordBatch.from_arrays(_pairs(one.column("doc_id"), texts), names=[c.split()[0] for c in RESULT.split(", ")])

    return walked.where("kind = 0").select(*[c.split()[0] for c in RESULT.split(", ")]).unionByName(lasts.mapInArrow(lean(close), RESULT))
