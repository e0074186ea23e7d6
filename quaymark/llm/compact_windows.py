"""Repeated passages across documents by compact windows.

Tokens are word 5-grams; a passage is WORDS words or more. Under one hash function, all passages of a document whose least
hash is at the same token form a compact window (l, c, r): the subtree of token c in the Cartesian tree of the hashes spans
l to r, and every passage inside that holds c has its hash as its minimum. Only subtrees as long as a passage are made. For
passages of exactly WORDS words a compact window is an interval of starts. There are HASHES functions.

1. A sieve: the windows of the first SIEVE functions whose minimum documents with different texts have are gathered by text (one
   aggregation over minima, one join; copies of a text count once, and no pairs are made).
2. Within a text, the windows' intervals are joined. Starts that lie in shared windows of all the sieve's functions are verified
   exactly: the words of each passage are hashed whole, and passages that two texts or more have are merged to spans.
3. Starts in a shared window of one of the sieve's functions and a window of another function form a cell, whose passages share
   both minima. The passages of a cell that do not lie inside an exact span are verified as near-duplicates: each is held
   against all passages of all other texts in its cell, and counts if the 5-gram sets reach a similarity of NEAR. Cells inside
   exact spans only stand against those, and of equal ones one stands for all. Cells of many texts are dealt to blocks, every
   two of which meet; equal sets are compared once.
4. Near passages that overlap, and the exact spans that they overlap, are merged to spans that are not exact; exact spans have
   rows of their own as well. Spans go to all documents with the text; a text of WORDS words or more that several documents have
   is one whole span.

A passage of similarity s shares two of three minima with the probability 0.90 at s = 0.8 and 0.97 at 0.9; a span is found if one of
its passages is.

Defined results: a word is ``[^\\x20\\x09-\\x0D]+``, compared byte for byte; null and short texts have no spans; documents without
spans have no rows; a passage that repeats within one document only is none; null doc_ids stay null; repeated rows are copies;
an empty table gives no rows; other columns are not read. Places are in words, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymark.llm import textkernel as K
from quaymark.llm.shared import dealt, discard, lean, pieces_of, tidy, written

SHINGLE, WORDS, NEAR, HASHES, SIEVE = 5, 50, 0.8, 3, 2
#: Bytes of a 5-gram's hash that are sent where cells meet: 512 cells have at most 50,000 of them, and 2**40 values tell them apart.
GRAM_BYTES = 5
SPAN = WORDS - SHINGLE + 1
PLACE_BITS = 26
#: Cells of a key that a block holds, about; two blocks meet in one row.
BLOCK = 256
#: Sets of passages that are held against each other at once.
ROWS = 512
#: Cells of a key that is looked at together with others, 5-grams of all of them, and signs of their sets.
FEW, GRAMS, SIGNS = 16, 60_000, 4_000_000
#: Rows sent to all tasks at most, and ids; more are joined by a shuffle.
MOST_SENT, MOST_IDS = 20_000, 200_000

_KEYS = K.mix(np.arange(11, 11 + HASHES, dtype=np.uint64))


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of each ``width`` consecutive ones."""
    held, size = values, 1
    while 2 * size <= width:
        held, size = np.minimum(held[:-size], held[size:]), 2 * size
    rest = width - size
    return np.minimum(held[: len(held) - rest], held[rest:]) if rest else held


def smaller_after(key: np.ndarray, n: int) -> np.ndarray:
    """For each place but the last the next one with a smaller value, no more than ``n`` places on; the last value is the least."""
    tables, size = [key], 1
    while 2 * size <= n:
        tables.append(np.minimum(tables[-1][:-size], tables[-1][size:]))
        size *= 2
    at = np.arange(1, len(key))
    own = key[:-1]
    for table in reversed(tables):  # whole runs of larger values are jumped over, long ones first
        larger = table[np.minimum(at, len(table) - 1)] > own
        at[larger & (at < len(table))] += len(key) - len(table) + 1
    return at


def compact_windows(values: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r), ends inclusive, of all subtrees of each text's Cartesian tree with at least ``width`` tokens; equal values count left first.

    A token has such a subtree just if it is the least of some ``width`` consecutive tokens, and the nearest smaller tokens
    on both sides, which end the subtree, then have one too. So the tree is built over those tokens alone.
    """
    n = len(values)
    if n < width:
        return (np.zeros(0, np.int64),) * 3
    # The leading bits, then the place. As many bits in every call (unless one text has 67 million words), so equal passages have equal minima.
    place = np.uint64(max(PLACE_BITS, int(n - 1).bit_length()))
    order = (values >> place << place) | np.arange(n, dtype=np.uint64)
    low = least_in_windows(order, width)
    doc = K.per_text(bounds)
    low = low[doc[: len(low)] == doc[width - 1 :]]
    if not len(low):
        return (np.zeros(0, np.int64),) * 3
    # The least token of a window that moves on moves on too, so equal ones are neighbours.
    low = low[np.concatenate([[True], low[1:] != low[:-1]])]
    c = (low & ((np.uint64(1) << place) - np.uint64(1))).astype(np.int64)
    of = doc[c]
    # Between texts stands a value that is less than all.
    gaps = np.concatenate([[0], np.cumsum(of[1:] != of[:-1])])
    at = np.arange(len(c)) + gaps + 1
    key = np.zeros(at[-1] + 2, np.uint64)
    key[at] = low
    place_of = np.zeros(len(key), np.int64)
    place_of[at] = c
    most = int(np.bincount(gaps).max()) + 1
    right = smaller_after(key, most)[at]
    left = len(key) - 1 - smaller_after(key[::-1], most)[len(key) - 1 - at]
    first, last = bounds[:-1][of], bounds[1:][of] - 1
    return np.where(key[left] > 0, place_of[left] + 1, first), c, np.where(key[right] > 0, place_of[right] - 1, last)


def starts_of(l: np.ndarray, c: np.ndarray, r: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:  # noqa: E741
    """The interval of starts of passages of just ``width`` tokens in each compact window."""
    return np.maximum(l, c - width + 1), np.minimum(c, r - width + 1)


def common(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, place in a, place in b) of the intersections of two lists of ascending disjoint intervals (first, last)."""
    if not len(a[0]) or not len(b[0]):
        return (np.zeros(0, np.int64),) * 4
    lo = np.union1d(a[0], b[0])
    i, j = np.searchsorted(a[0], lo, side="right") - 1, np.searchsorted(b[0], lo, side="right") - 1
    inside = (i >= 0) & (j >= 0)
    hi = np.minimum(a[1][i], b[1][j])
    inside &= hi >= lo
    return lo[inside], hi[inside], i[inside], j[inside]


def text_id(text: Column, half: int = 0) -> Column:
    """64 bits of the text's MD5 (the bytes alone decide): the first or the second half."""
    return F.conv(F.substring(F.md5(F.coalesce(text.cast("string"), F.lit(""))), 1 + 16 * half, 16), 16, -10).cast("long")


def _texts(docs: DataFrame) -> DataFrame:
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return held.where(F.col("text").isNotNull()).withColumn("id", text_id(F.col("text")))


def _each(f):
    """A mapInArrow function from one of (part, data, offsets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch):
                out = f(part, *K.buffer_of(part.column("text")))
                if out is not None:
                    yield out

    return run


def _counted(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    _, _, bounds = K.words(data, offsets)
    return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("id"), part.column("twin"), pa.array(np.diff(bounds))], names=["doc_id", "id", "twin", "n_words"])


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, bounds, 5-grams, bounds)."""
    starts, ends, bounds = K.words(data, offsets)
    hashed = K.segment_hashes(data, starts, ends)
    return hashed, bounds, *K.gram_hashes(hashed, bounds, SHINGLE)


def intervals(grams: np.ndarray, bounds: np.ndarray, f: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, minimum) of the starts of each compact window of a function; they cover all starts."""
    values = K.mix(grams ^ _KEYS[f])
    window = compact_windows(values, bounds, SPAN)
    return *starts_of(*window, SPAN), values[window[1]].view(np.int64)


def _windows(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    """The sieve's windows of each text."""
    _, _, grams, bounds = _grams(data, offsets)
    found = [intervals(grams, bounds, f) for f in range(SIEVE)]
    lo, hi, key = (np.concatenate(x) for x in zip(*found, strict=True))
    f = np.repeat(np.arange(SIEVE, dtype=np.int8), [len(x[0]) for x in found])
    doc = K.per_text(bounds)[lo]
    return pa.RecordBatch.from_arrays([pa.array(key), part.column("id").take(pa.array(doc)), pa.array(f), *(pa.array((x - bounds[doc]).astype(np.int32)) for x in (lo, hi))], names=["key", "id", "f", "lo", "hi"])


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """(row of each item, all items) of a column of lists of structs."""
    return np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)), column.flatten()


def _shared(column: pa.Array, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The texts' shared windows of each of the sieve's functions, as ``intervals`` gives all of them."""
    row, flat = _lists(column)
    f, key, lo, hi = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("f", "key", "lo", "hi"))
    lo, hi = bounds[row] + lo, np.minimum(bounds[row] + hi, bounds[1:][row] - SPAN)
    out = []
    for k in range(SIEVE):
        at = np.flatnonzero((f == k) & (lo <= hi))
        at = at[np.argsort(lo[at], kind="stable")]
        at = at[np.concatenate([[True], lo[at][1:] > lo[at][:-1]])] if len(at) else at
        out.append((lo[at], hi[at], key[at]))
    return out


def _passages(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    """The hash of each candidate passage's words."""
    hashed, words, _, grams = _grams(data, offsets)
    lo, hi = None, None
    for some in _shared(part.column("windows"), grams):
        lo, hi = some[:2] if lo is None else common((lo, hi), some[:2])[:2]
    whole, bounds = K.gram_hashes(hashed, words, WORDS)
    size = hi - lo + 1
    at = np.arange(int(size.sum())) + np.repeat(lo - np.cumsum(size) + size, size)  # among all 5-grams
    of = np.searchsorted(grams, at, side="right") - 1
    start = at - grams[of]
    return pa.RecordBatch.from_arrays([pa.array(whole[bounds[of] + start].view(np.int64)), part.column("id").take(pa.array(of)), pa.array(start.astype(np.int32))], names=["passage", "id", "start"])


def free_starts(spans: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """For each 5-gram, 1 unless the passage that starts there lies inside an exact span of its text."""
    row, flat = _lists(spans)
    mark = np.zeros(int(bounds[-1]) + 1, dtype=np.int64)
    np.add.at(mark, bounds[row] + flat.field("start").to_numpy(zero_copy_only=False), 1)
    np.add.at(mark, bounds[row] + flat.field("stop").to_numpy(zero_copy_only=False) - WORDS + 1, -1)
    return (np.cumsum(mark[:-1]) == 0).astype(np.uint8)


def run_hashes(grams: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each run of SPAN to 2 * SPAN - 1 grams: of three windows that cover it, and its size."""
    held = K.windows(grams, 32)
    end = first + size - 32
    with np.errstate(over="ignore"):
        return K.mix(K.joined(K.joined(held[first], held[np.minimum(first + 32, end)]), held[end]) + size.astype(np.uint64))


def _cells(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    """The cells of each text, a hash of their grams, and whether a passage of theirs lies in no exact span."""
    _, _, grams, bounds = _grams(data, offsets)
    sieve = _shared(part.column("windows"), bounds)
    others = [intervals(grams, bounds, f) for f in range(SIEVE, HASHES)]
    free = np.concatenate([[0], np.cumsum(free_starts(part.column("spans"), bounds))])
    found = []
    for f, a in enumerate(sieve):
        for g, b in enumerate([*sieve, *others]):
            if g > f:
                lo, hi, i, j = common(a[:2], b[:2])
                with np.errstate(over="ignore"):
                    key = K.mix(a[2][i].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b[2][j].view(np.uint64) + np.uint64(HASHES * f + g))
                found.append((lo, hi, key))
    lo, hi, key = (np.concatenate(x) for x in zip(*found, strict=True))
    doc = K.per_text(bounds)[lo]
    run = run_hashes(grams, lo, hi - lo + SPAN) if len(lo) else key
    places = (pa.array((x - bounds[doc]).astype(np.int32)) for x in (lo, hi))
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(run.view(np.int64)), part.column("id").take(pa.array(doc)), *places, pa.array(free[hi + 1] > free[lo])], names=["key", "run", "id", "lo", "hi", "free"])


def _runs(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    """The 5-grams of each cell asked for, and a byte per start: 1 unless its passage lies inside an exact span."""
    _, _, grams, bounds = _grams(data, offsets)
    free = free_starts(part.column("spans"), bounds)
    doc, flat = _lists(part.column("cells"))
    lo, hi = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi"))
    first, starts = bounds[doc] + lo, (hi - lo + 1).astype(np.int64)

    def gathered(values: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)
        return values[at], pa.array(np.concatenate([[0], ends]).astype(np.int32))

    def bytes_of(values: np.ndarray, ends: pa.Array, width: int) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.to_numpy() * np.int32(width)), pa.py_buffer(np.ascontiguousarray(values))])

    opened = bytes_of(*gathered(free, starts), 1)
    short = np.ascontiguousarray(grams.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :GRAM_BYTES]
    held = bytes_of(*gathered(short, starts + SPAN - 1), GRAM_BYTES)
    return pa.RecordBatch.from_arrays([*(flat.field(c) for c in ("key", "blocks")), part.column("id").take(pa.array(doc)), flat.field("high"), flat.field("lo"), opened, held], names=["key", "blocks", "low", "high", "lo", "free", "grams"])


def alike(least_id: np.ndarray, most_id: np.ndarray, sizes: np.ndarray, free: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """For each start of some cells, one after the other, whether it is free and its passage near to one of another text.

    A cell stands for texts from ``least_id`` to ``most_id``; one with a free start is a single text's. ``sizes`` counts the starts of each cell; a cell has SPAN - 1 more grams. All passages meet. Grams that only one text has
    cannot be common, and passages with the same other grams are compared once.
    """
    none = np.zeros(int(sizes.sum()), dtype=bool)
    run = np.repeat(np.arange(len(sizes)), sizes + SPAN - 1)
    _, name = np.unique(grams, return_inverse=True)
    low, high = np.full(name.max() + 1, np.iinfo(np.int64).max), np.full(name.max() + 1, np.iinfo(np.int64).min)
    np.minimum.at(low, name, least_id[run])
    np.maximum.at(high, name, most_id[run])
    common = low != high
    # A gram counts in a passage where it stands first there.
    order = np.lexsort((np.arange(len(name)), name, run))
    before = np.full(len(name), -1)
    again = (name[order][1:] == name[order][:-1]) & (run[order][1:] == run[order][:-1])
    before[order[1:][again]] = order[:-1][again]
    cell = np.repeat(np.arange(len(sizes)), sizes)
    start = np.arange(len(cell)) + cell * (SPAN - 1)
    window = start[:, None] + np.arange(SPAN)
    counts = before[window] < start[:, None]
    size = counts.sum(axis=1)
    shared = counts & common[name[window]]
    able = np.flatnonzero(shared.sum(axis=1) >= NEAR * size)
    if not len(able) or not free[able].any():
        return none
    column, width = np.cumsum(common) - 1, int(common.sum())
    bits = []
    for a in range(0, len(able), ROWS):
        some = able[a : a + ROWS]
        sets = np.zeros((len(some), width), dtype=np.uint8)
        r, j = np.nonzero(shared[some])
        sets[r, column[name[window[some[r], j]]]] = 1
        bits.append(np.packbits(sets, axis=1))
    held = np.concatenate([size[able, None].astype(np.uint8), np.concatenate(bits)], axis=1)
    _, first, which = np.unique(np.ascontiguousarray(held).view(np.dtype((np.void, held.shape[1]))).ravel(), return_index=True, return_inverse=True)
    own, n, held = least_id[cell[able]], size[able][first], held[first, 1:]
    low, high = np.full(len(first), np.iinfo(np.int64).max), np.full(len(first), np.iinfo(np.int64).min)
    np.minimum.at(low, which, own)
    np.maximum.at(high, which, most_id[cell[able]])
    least, most = np.full_like(low, np.iinfo(np.int64).max), np.full_like(high, np.iinfo(np.int64).min)
    dense = lambda a: np.unpackbits(held[a : a + ROWS], axis=1, count=width).astype(np.float32)
    for a in range(0, len(first), ROWS):
        mine = dense(a)
        for b in range(0, len(first), ROWS):
            both = mine @ dense(b).T
            near = both >= NEAR * (n[a : a + ROWS, None] + n[None, b : b + ROWS] - both) - 1e-4
            r, j = np.nonzero(near)
            np.minimum.at(least, a + r, low[b + j])
            np.maximum.at(most, a + r, high[b + j])
    none[able] = free[able] & (least[which] <= most[which]) & ((least[which] != own) | (most[which] != own))
    return none


def alike_in_few(key: np.ndarray, least_id: np.ndarray, most_id: np.ndarray, sizes: np.ndarray, free: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """``alike`` for the cells of many keys (ascending numbers), each with few: what can be done for all of them at once is."""
    hit = np.zeros(int(sizes.sum()), dtype=bool)
    run = np.repeat(np.arange(len(sizes)), sizes + SPAN - 1)
    _, name = np.unique(key[run].astype(np.uint64) << np.uint64(8 * GRAM_BYTES) | grams, return_inverse=True)  # names go by keys
    low, high = np.full(name.max() + 1, np.iinfo(np.int64).max), np.full(name.max() + 1, np.iinfo(np.int64).min)
    np.minimum.at(low, name, least_id[run])
    np.maximum.at(high, name, most_id[run])
    common = low != high
    order = np.lexsort((np.arange(len(name)), name, run))
    before = np.full(len(name), -1)
    again = (name[order][1:] == name[order][:-1]) & (run[order][1:] == run[order][:-1])
    before[order[1:][again]] = order[:-1][again]
    cell = np.repeat(np.arange(len(sizes)), sizes)
    start = np.arange(len(cell)) + cell * (SPAN - 1)
    window = start[:, None] + np.arange(SPAN)
    counts = before[window] < start[:, None]
    size = counts.sum(axis=1)
    shared = counts & common[name[window]]
    able = np.flatnonzero(shared.sum(axis=1) >= NEAR * size)
    of = key[cell[able]]
    open_ = np.zeros(int(key[-1]) + 1, bool)
    open_[of[free[able]]] = True
    able, of = able[open_[of]], of[open_[of]]
    if not len(able):
        return hit
    column = np.cumsum(common) - 1
    first = np.full(int(key[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, key[run], column[name] + ~common[name])  # a key's columns begin at its least common name
    begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])).tolist()
    ends = [*begin[1:], len(able)]
    r, j = np.nonzero(shared[able])
    at = column[name[window[able[r], j]]] - first[of[r]]
    width = int(at.max()) + 1
    own, top, n, opened = least_id[cell[able]], most_id[cell[able]], size[able].astype(np.float32), free[able]
    step = max(1, SIGNS // width)
    a = 0
    while a < len(begin):  # some keys at a time
        b = a + 1
        while b < len(begin) and ends[b] - begin[a] <= step:
            b += 1
        lo, hi = begin[a], ends[b - 1]
        x, y = np.searchsorted(r, [lo, hi])
        sets = np.zeros((hi - lo, width), np.float32)
        sets[r[x:y] - lo, at[x:y]] = 1
        for i, e in zip(begin[a:b], ends[a:b], strict=True):
            mine, m = sets[i - lo : e - lo], n[i:e]
            both = mine @ mine.T
            near = both * (1 + NEAR) >= NEAR * (m[:, None] + m) - 1e-3
            near &= (own[None, i:e] != own[i:e, None]) | (top[None, i:e] != own[i:e, None])
            hit[able[i:e]] = near.any(axis=1) & opened[i:e]
        a = b
    return hit


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, start, passage of the free starts of each row's cells that are near to another text's."""
    for batch in batches:
        lists = batch.column("runs")
        row, flat = _lists(lists)
        cut = np.searchsorted(row, np.arange(len(lists) + 1))
        low, high, lo = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("low", "high", "lo"))
        opened = flat.field("free")
        sizes = pc.binary_length(opened).to_numpy(zero_copy_only=False).astype(np.int64)
        free = np.frombuffer(b"".join(opened.to_pylist()), dtype=np.uint8) > 0
        whole = np.zeros((len(free) + (SPAN - 1) * len(sizes), 8), np.uint8)
        whole[:, :GRAM_BYTES] = np.frombuffer(b"".join(flat.field("grams").to_pylist()), np.uint8).reshape(-1, GRAM_BYTES)
        whole = whole.view("<u8").ravel()
        at, of = np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([[0], np.cumsum(sizes + SPAN - 1)])
        hit = np.zeros(len(free), dtype=bool)
        some = np.concatenate([[0], np.cumsum(free)])
        several = (some[at[cut[1:]]] > some[at[cut[:-1]]]) & (np.minimum.reduceat(low, cut[:-1]) != np.maximum.reduceat(high, cut[:-1])) if len(low) else np.zeros(0, bool)
        few = several & (np.diff(cut) <= FEW)
        for k in np.flatnonzero(several & ~few).tolist():
            a, b = int(cut[k]), int(cut[k + 1])
            hit[at[a] : at[b]] = alike(low[a:b], high[a:b], sizes[a:b], free[at[a] : at[b]], whole[of[a] : of[b]])
        size = np.where(few, of[cut[1:]] - of[cut[:-1]], 0)
        group = np.cumsum(size) // GRAMS
        for g in np.unique(group[few]).tolist():
            keys = np.flatnonzero(few & (group == g))
            a, b = int(cut[keys[0]]), int(cut[keys[-1] + 1])
            mine = np.zeros(len(lists), np.int64)
            mine[keys] = np.arange(len(keys))
            inside = (few & (group == g))[row[a:b]]
            starts, signs = np.repeat(inside, sizes[a:b]), np.repeat(inside, sizes[a:b] + SPAN - 1)
            c = a + np.flatnonzero(inside)
            hit[at[a] + np.flatnonzero(starts)] = alike_in_few(mine[row[c]], low[c], high[c], sizes[c], free[at[a] : at[b]][starts], whole[of[a] : of[b]][signs])
        found = np.flatnonzero(hit)
        cell = np.searchsorted(at, found, side="right") - 1
        key = batch.column("key").to_numpy()[row[cell]]
        yield pa.RecordBatch.from_arrays([pa.array(low[cell]), pa.array((lo[cell] + found - at[cell]).astype(np.int32)), pa.array(key)], names=["id", "start", "passage"])


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, spans: merged runs of passages, each named by its least passage hash."""
    for batch in batches:
        row, flat = _lists(batch.column("found"))
        start, passage, exact = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "passage", "exact"))
        order = np.lexsort((start, row))
        row, start, passage, exact = row[order], start[order].astype(np.int64), passage[order], exact[order]
        first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] > start[:-1] + WORDS)])) if len(row) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(row)) - 1
        spans = pa.StructArray.from_arrays(
            [pa.array(start[first].astype(np.int32)), pa.array((start[last] + WORDS).astype(np.int32)), pa.array(np.minimum.reduceat(passage, first) if len(first) else passage), pa.array(np.logical_and.reduceat(exact, first) if len(first) else exact.astype(bool))],
            names=["start", "stop", "passage", "exact"],
        )
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=batch.num_rows))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(offsets), spans)], names=["id", "spans"])


_SPANS = "id long, spans array<struct<start: int, stop: int, passage: long, exact: boolean>>"


def merged(found: DataFrame) -> DataFrame:
    """id, spans from rows id, start, passage, exact; a text has at most as many different rows as words."""
    return found.groupBy("id").agg(F.collect_list(F.struct("start", "passage", "exact")).alias("found")).mapInArrow(lean(_spans), _SPANS)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, spans: each text's near passages, with the exact spans that they overlap."""
    for batch in batches:
        row, flat = _lists(batch.column("found"))
        other, spans = _lists(batch.column("spans"))
        start, begin = (x.field("start").to_numpy(zero_copy_only=False).astype(np.int64) for x in (flat, spans))
        end = spans.field("stop").to_numpy(zero_copy_only=False).astype(np.int64)
        none = np.iinfo(np.int64).max
        rows, first, last = np.concatenate([row, other]), np.concatenate([start, begin]), np.concatenate([start + WORDS, end])
        passage = np.concatenate([flat.field("passage").to_numpy(zero_copy_only=False), np.full(len(begin), none)])
        order = np.lexsort((first, rows))
        rows, first, last, passage = rows[order], first[order], last[order], passage[order]
        room = int(last.max()) + 2
        upto = np.maximum.accumulate(rows * room + last)  # the end of what came before, texts one after another
        new = np.flatnonzero(np.concatenate([[True], rows[1:] * room + first[1:] > upto[:-1]]))
        least = np.minimum.reduceat(passage, new)
        stop = np.maximum.reduceat(last, new)
        near = least < none
        found = pa.StructArray.from_arrays([pa.array(first[new][near].astype(np.int32)), pa.array(stop[near].astype(np.int32)), pa.array(least[near]), pa.array(np.zeros(int(near.sum()), bool))], names=["start", "stop", "passage", "exact"])
        offsets = np.concatenate([[0], np.cumsum(np.bincount(rows[new][near], minlength=batch.num_rows))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(offsets), found)], names=["id", "spans"])


def joined_spans(near: DataFrame, exact: DataFrame) -> DataFrame:
    """id, spans: the spans that near passages (id, start, passage) make, alone or with exact spans."""
    lists = near.groupBy("id").agg(F.collect_list(F.struct("start", "passage")).alias("found")).join(exact, "id", "left")
    return lists.select("id", "found", "spans").mapInArrow(lean(_joined), _SPANS)


def _sent(df: DataFrame, weight: Column) -> DataFrame:
    """df, marked to be sent to all tasks if that is little; else its partitions are hashed, so the other side is not sorted."""
    few = (df.agg(F.sum(weight).alias("n")).first()["n"] or 0) <= MOST_SENT
    tidy(df.sparkSession)
    return F.broadcast(df) if few else df.hint("shuffle_hash")


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, start_word, end_word, passage, exact: the spans of each document that other documents have too."""
    texts = _texts(docs)
    counted = texts.withColumn("twin", text_id(F.col("text"), 1)).mapInArrow(lean(_each(_counted)), "doc_id long, id long, twin long, n_words long")
    slim = written(counted, "texts")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id")).alias("first")
    groups = slim.groupBy("id", "twin").agg(F.count(F.lit(1)).alias("copies"), F.max("n_words").alias("n_words"), first)

    # From here on one document stands for all with its text.
    copies = written(groups.where("copies > 1").select(F.col("id").alias("id_"), "twin", F.col("first.doc_id").alias("first_id"), "n_words", F.lit(True).alias("many")), "copies")
    many = copies.select("id_", "first_id", "many")
    texts = texts.join(_sent(many, F.lit(1)), F.col("id") == F.col("id_"), "left").where(F.col("many").isNull() | F.col("doc_id").eqNullSafe(F.col("first_id"))).select("text", "id")

    windows = written(texts.mapInArrow(lean(_each(_windows)), "key long, id long, f tinyint, lo int, hi int"), "windows")
    shared = written(windows.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least != most").select("key"), "shared")
    mine = windows.join(_sent(shared, F.lit(1)), "key", "left_semi").groupBy("id").agg(F.collect_list(F.struct("f", "key", "lo", "hi")).alias("windows"))
    by_text = written(mine, "wanted")
    discard(windows, shared)
    wanted = by_text.select("id")
    few = wanted.count() <= MOST_IDS
    chosen = texts.join(F.broadcast(wanted), "id", "left_semi") if few else texts
    # Texts move once, to buckets of their ids; later steps bring their lists to them.
    held = dealt(chosen.join(by_text.hint("shuffle_hash"), "id").select("id", "text", "windows"), "id", "passages")
    discard(by_text)
    passages = held.mapInArrow(lean(_each(_passages)), "passage long, id long, start int")
    twice = written(passages.groupBy("passage").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a != b").select("passage"), "twice")
    exact = written(merged(passages.join(_sent(twice, F.lit(1)), "passage", "left_semi").withColumn("exact", F.lit(True))), "spans")

    discard(twice)
    near = near_passages(held, exact)
    spans = written(joined_spans(near, exact).unionByName(exact), "spans")
    discard(held, exact, near)
    # Documents: whole copies, then spans of their text.
    copied = copies.where(F.col("n_words") >= WORDS).select(F.col("id_").alias("id"), "twin")
    one = slim.join(copied, ["id", "twin"], "left_semi").select("doc_id", F.lit(0).alias("start_word"), F.col("n_words").cast("int").alias("end_word"), F.col("id").alias("passage"), F.lit(True).alias("exact"))
    parts = slim.join(copied, ["id", "twin"], "left_anti").join(spans, "id").select("doc_id", F.explode("spans").alias("s"))
    return one.unionByName(parts.select("doc_id", F.col("s.start").alias("start_word"), F.col("s.stop").alias("end_word"), F.col("s.passage").alias("passage"), F.col("s.exact").alias("exact")))


def near_passages(held: DataFrame, exact: DataFrame) -> DataFrame:
    """id, start, passage of passages of the texts (id, text, windows) that are near-duplicates of another text's in a common cell, unless they lie inside an exact span."""
    spans = exact.select("id", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))).alias("spans"))
    whole = held.join(spans.hint("shuffle_hash"), "id", "left")
    cells = written(whole.mapInArrow(lean(_each(_cells)), "key long, run long, id long, lo int, hi int, free boolean"), "cells")
    ends = cells.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.max(F.col("free").cast("int")).alias("open"))
    live = written(ends.where("least != most AND open = 1").select("key"), "live")
    asked = written(cells.join(_sent(live, F.lit(1)), "key", "left_semi"), "asked")
    discard(cells, live)
    # Of equal cells without a free start one stands for all; a cell with one has no equal in another text.
    place = F.min(F.struct("id", "lo", "hi")).alias("at")
    closed = asked.where(~F.col("free")).groupBy("key", "run").agg(place, F.max("id").alias("high")).select("key", "at.id", "at.lo", "at.hi", "high")
    rows = written(asked.where("free").select("key", "id", "lo", "hi", F.col("id").alias("high")).distinct().unionByName(closed), "asked")
    discard(asked)
    blocks = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    by_text = rows.join(blocks, "key").groupBy("id").agg(F.collect_list(F.struct("key", "blocks", "high", "lo", "hi")).alias("cells"))
    runs = whole.select("id", "text", "spans").join(by_text.hint("shuffle_hash"), "id").mapInArrow(lean(_each(_runs)), "key long, blocks int, low long, high long, lo int, free binary, grams binary")
    # Cells are dealt to blocks by a hash; every two blocks of a key meet.
    block = F.pmod(F.xxhash64("low", "lo"), F.col("blocks")).cast("int")
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, block).alias("i"), F.greatest(x, block).alias("j")))
    twos = runs.select("key", "low", "high", "lo", "free", "grams", F.explode(met).alias("b")).groupBy("key", "b.i", "b.j").agg(F.collect_list(F.struct("low", "high", "lo", "free", "grams")).alias("runs"))
    near = twos.select("key", "runs").mapInArrow(lean(_near), "id long, start int, passage long")
    out = written(near.groupBy("id", "start").agg(F.min("passage").alias("passage")), "near")
    discard(rows)
    return out
