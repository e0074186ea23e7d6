"""Packing by non-negative least squares over a length histogram.

Each document's ids, with an end id, are cut from the front into pieces of a whole window and one shorter rest, so a
piece's checksum is known where the ids are made and no ids are moved. The rests are packed by their lengths alone:

1. a histogram of the rests' lengths (at most ``window - 1`` counters, however large the corpus);
2. shallow combinations of two or three lengths that fill the window exactly;
3. non-negative least squares for how often each combination is used, so that together they come near the histogram;
4. the counts are rounded down to what the histogram still holds;
5. what is left is packed greedily, again by counts: a pattern is filled with the largest lengths that fit and repeated
   as often as the counts allow.

The result is a list of patterns with repeats. Pieces of one length are ranked (a count by task and length, and a rank
within both), and a rank is looked up in the patterns' ranges. Nothing is sorted by key and no group is gathered.

Defined results: a null or empty text has the end id alone (one piece of length 1); a null doc_id stays null and its
pieces are packed like others; repeated rows are packed as often as they occur, each with its own pieces; an empty table
gives no rows; other columns of the input are not read. A text of any length is cut; each id lies in one piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.llm import bpe
from quaymark.llm.shared import lean, pieces_of, written

#: Smallest parts of combinations of three lengths are multiples of this; it bounds their number to about window**2 / (6 * GRID).
GRID = 8
#: Steps of the least-squares solver at most; it looks at its error every CHECKED steps and ends when that falls by less than GAIN of itself.
STEPS, CHECKED, GAIN = 2000, 50, 1e-3
#: Rows of counts that are sent to all tasks at most; more are joined by a shuffle.
MOST_SENT = 200_000


def combinations(window: int, grid: int = GRID) -> np.ndarray:
    """Rows of three ascending lengths (0: none) with the sum ``window``: all pairs, and triples with a least part on the grid."""
    pairs = [(0, a, window - a) for a in range(1, window // 2 + 1)]
    triples = [(a, b, window - a - b) for a in range(grid, window // 3 + 1, grid) for b in range(a, (window - a) // 2 + 1)]
    return np.array(pairs + triples, dtype=np.int64).reshape(-1, 3)


def least_squares(combos: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative x near min |A x - histogram|, A[l, c] = how often combination c has length l.

    Multiplicative updates, which keep x non-negative and never raise the error, until it rests; A stays implicit.
    """
    if not len(combos) or not histogram.sum():
        return np.zeros(len(combos))
    # Errors count in proportion to what the histogram has, so rare lengths matter too.
    weight = 1.0 / np.maximum(histogram, 1.0)
    weight[0] = 0.0
    h = histogram.astype(float)
    h[0] = 0.0
    top = (weight * h)[combos].sum(axis=1)
    x = np.full(len(combos), h.sum() / (3.0 * len(combos)))
    size = len(histogram)
    error = np.inf
    for k in range(steps):
        fitted = np.bincount(combos.ravel(), weights=np.repeat(x, 3), minlength=size)
        if k % CHECKED == 0:
            now = float((weight * np.square(h - fitted)).sum())
            if now >= (1 - GAIN) * error:
                break
            error = now
        x *= top / np.maximum((weight * fitted)[combos].sum(axis=1), 1e-12)
    return x


def patterns(histogram: np.ndarray, window: int, grid: int = GRID, steps: int = STEPS) -> list[tuple[int, tuple[int, ...]]]:
    """(repeats, lengths) that use up the histogram of lengths 0..window exactly (0 is ignored)."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[int, tuple[int, ...]]] = []
    if left[window]:
        out.append((int(left[window]), (window,)))
        left[window] = 0
    combos = combinations(window, grid)
    times = least_squares(combos, left, steps)
    for c in np.argsort(-times, kind="stable"):
        lengths = tuple(int(v) for v in combos[c] if v)
        n = round(times[c])
        for v in set(lengths):
            n = min(n, int(left[v]) // lengths.count(v))
        if n > 0:
            out.append((n, lengths))
            for v in lengths:
                left[v] -= n
    while left.any():
        room, lengths, held = window, [], left.copy()
        while True:
            fits = np.flatnonzero(held[: room + 1])
            if not len(fits):
                break
            v = int(fits[-1])
            n = min(int(held[v]), room // v)
            lengths += [v] * n
            held[v] -= n
            room -= n * v
        n = min(int(left[v]) // lengths.count(v) for v in set(lengths))
        out.append((n, tuple(lengths)))
        for v in lengths:
            left[v] -= n
    return out


class Places:
    """For each length, ranges of ranks and where they lie; as large as the patterns, whatever the corpus."""

    def __init__(self, found: list[tuple[int, tuple[int, ...]]], window: int):
        by: dict[int, list[tuple[int, int, int, int]]] = {}
        used, first = np.zeros(window + 1, dtype=np.int64), 0
        for n, lengths in found:
            at = 0
            for v in dict.fromkeys(lengths):
                m = lengths.count(v)
                by.setdefault(v, []).append((int(used[v]), m, first, at))
                used[v] += n * m
                at += m * v
            first += n
        self.by = {v: tuple(np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)) for v, rows in by.items()}
        self.sequences = first

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces with these lengths and ranks among their length."""
        seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for v in np.unique(length).tolist():
            of = length == v
            lo, times, first, at = self.by[v]
            k = np.searchsorted(lo, rank[of], side="right") - 1
            t = rank[of] - lo[k]
            seq[of] = first[k] + t // times[k]
            off[of] = at[k] + (t % times[k]) * v
        return seq, off


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, nth long"


def cut(docs: DataFrame, window: int, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: its document, place and checksum; task and nth tell it from others of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe.encoder(vocabulary or bpe.default_path()).encode
        task = TaskContext.get().partitionId()
        seen = np.zeros(window + 1, dtype=np.int64)
        for batch in batches:
            for part in pieces_of(batch):
                ids, at = encode(part.column("text"))
                sizes = np.diff(at)
                counts = -(-sizes // window)
                doc = np.repeat(np.arange(len(sizes)), counts)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)) * window
                length = np.minimum(window, sizes[doc] - start)
                raw = memoryview(ids.astype("<u4").tobytes())
                lo = at[doc] + start
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(lo.tolist(), (lo + length).tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                ranked = length[order]
                nth = np.empty(len(doc), np.int64)
                nth[order] = np.arange(len(doc)) - np.searchsorted(ranked, ranked) + seen[ranked]
                seen += np.bincount(length, minlength=window + 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(sizes[doc]), pa.array(np.full(len(doc), task)), pa.array(nth)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "nth"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), PIECES)


def pack(docs: DataFrame, window: int = 1024, vocabulary: str | None = None, grid: int = GRID, steps: int = STEPS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece; sequences are numbered from 0 without gaps."""
    pieces = written(cut(docs, window, vocabulary), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = written(by_task.select("length", "task", "n", (F.sum("n").over(_running()) - F.col("n")).alias("before")), "ranks")
    histogram = np.zeros(window + 1, dtype=np.int64)
    for row in before.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most one row per length
        histogram[row["length"]] = row["n"]
    places = Places(patterns(histogram, window, grid, steps), window)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = places.find(length, rank)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(seq), pa.array(off)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    counts = before.select("length", "task", "before")
    counts = F.broadcast(counts) if counts.count() <= MOST_SENT else counts.hint("shuffle_hash")
    ranked = pieces.join(counts, ["length", "task"]).withColumn("rank", F.col("before") + F.col("nth"))
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(lean(place), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def _running():
    from pyspark.sql import Window

    return Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, 0)
