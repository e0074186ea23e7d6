"""Words, lines and shingles of a batch of texts as numpy arrays, without a Python object per word.

Texts are looked at as one UTF-8 buffer with offsets, as Arrow has them. A word is a run of bytes other than
``\\x20 \\x09-\\x0D``. A segment's hash depends on its bytes alone, so it is the same in every process. It takes eight bytes at
a time through a mixing bijection (segments of up to eight bytes never collide with others of their length), and BLAKE2b
for long segments; nothing in it is linear, so no structure of a text makes hashes equal. Where equality decides what is
removed, ``digests`` gives 128 bits of BLAKE2b.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Segments of more bytes than this are hashed one by one.
LONG = 128

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U64(27))
        x = x * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return held, at - at[0]


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds) of the runs of True that do not cross a text's end; text d has runs bounds[d]:bounds[d + 1]."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    first[cuts] = mask[cuts]
    last[cuts - 1] = mask[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return runs(~IS_SPACE[data], offsets)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds) of the lines, split at each newline alone; every text has a last line, maybe an empty one."""
    ends = np.flatnonzero(data == 10)
    d = np.searchsorted(offsets, ends, side="right") - 1
    order = np.lexsort((np.concatenate([ends, offsets[1:]]), np.concatenate([d, np.arange(len(offsets) - 1)])))
    all_ends = np.concatenate([ends, offsets[1:]])[order]
    last = np.concatenate([np.zeros(len(ends), bool), np.ones(len(offsets) - 1, bool)])[order]
    bounds = np.concatenate([[0], np.flatnonzero(last) + 1])
    starts = np.empty_like(all_ends)
    starts[1:] = all_ends[:-1] + 1
    starts[bounds[:-1]] = offsets[:-1]
    return starts, all_ends, bounds


_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U64)


def eights(data: np.ndarray) -> np.ndarray:
    """For each place the eight bytes from there on as one number (behind the end: zeros)."""
    held = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", held, strides=(1,))


def leading_bytes(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first eight bytes of each segment as one number, and the next eight; zeros behind its end."""
    loaded = eights(data)
    later = np.minimum(starts + 8, len(data))
    return loaded[starts] & _MASKS[np.clip(size, 0, 8)], loaded[later] & _MASKS[np.clip(size - 8, 0, 8)]


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each segment's bytes."""
    size = ends - starts
    out = mix(size.astype(U64) + U64(0x9E3779B97F4A7C15))
    long = np.flatnonzero(size > LONG)
    if len(long):
        raw = memoryview(data)
        hashed = b"".join(blake2b(raw[s:e], digest_size=8).digest() for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True))
        out[long] = np.frombuffer(hashed, "<u8")
    live = np.flatnonzero((size > 0) & (size <= LONG))
    if not len(live):
        return out
    loaded = eights(data)
    at, left, acc = starts[live], size[live], out[live]
    while len(live):
        acc = mix(acc ^ (loaded[at] & _MASKS[np.minimum(left, 8)]))
        more = left > 8
        if more.all():
            at, left = at + 8, left - 8
            continue
        out[live[~more]] = acc[~more]
        live, at, left, acc = live[more], at[more] + 8, left[more] - 8, acc[more]
    return out


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128 bits of BLAKE2b of each segment's bytes, as rows of 16 bytes (kind S16): as good as comparing the bytes."""
    raw = memoryview(data)
    return np.frombuffer(b"".join(blake2b(raw[s:e], digest_size=16).digest() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), "S16")


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two hashes in this order."""
    with np.errstate(over="ignore"):
        return mix(a * U64(0xD6E8FEB86659FD93) + b)


def windows(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values: of halves that are hashed before, so it takes about log(k) steps."""
    n = len(values) - k + 1
    out, upto, held, size = None, 0, values, 1
    while True:
        if k & size:
            part = held[upto : upto + n]
            out = part if out is None else joined(out, part)
            upto += size
        if 2 * size > k:
            return mix(out) if k == 1 else out
        held, size = joined(held[:-size], held[size:]), 2 * size


def gram_hashes(values: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of k consecutive values within a text, bounds by text); a text with fewer values has none."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(len(bounds), np.int64)
    hashed = windows(values, k)
    counts = np.maximum(np.diff(bounds) - (k - 1), 0)
    inside = np.ones(n, dtype=bool)
    cut = bounds[1:-1]
    for j in range(1, k):  # a gram that starts less than k values before a text's end runs over it
        at = cut - j
        inside[at[(at >= 0) & (at < n)]] = False
    return hashed[inside], np.concatenate([[0], np.cumsum(counts)])


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of each text's k-word shingles in order. A text of 1 to k - 1 words has one shingle of them all; one without words has none."""
    starts, ends, bounds = words(data, offsets)
    hashed = segment_hashes(data, starts, ends)
    grams, at = gram_hashes(hashed, bounds, k)
    few = np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < k))
    if not len(few):
        return grams, at
    whole = [windows(hashed[bounds[d] : bounds[d + 1]], int(bounds[d + 1] - bounds[d]))[0] for d in few]
    counts = np.diff(at)
    out = np.insert(grams, at[few], np.array(whole, dtype=U64))
    counts[few] = 1
    return out, np.concatenate([[0], np.cumsum(counts)])


def per_text(bounds: np.ndarray) -> np.ndarray:
    """For each item, the index of its text."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
